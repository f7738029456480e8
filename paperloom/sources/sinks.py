"""Exports: JSON, Markdown, ZIP; tables by append and by replaced keys."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_documents(questions: DataFrame, order: str = "question_number") -> DataFrame:
    """One JSON array of questions per document, in order."""
    cols = [c for c in questions.columns if c not in ("document_id", order)]
    rows = F.sort_array(F.collect_list(F.struct(order, F.to_json(F.struct(F.col(order), *cols), {"ignoreNullFields": "false"}).alias("j"))))
    return questions.groupBy("document_id").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["j"]), ","), F.lit("]")).alias("json"))


def markdown(number: Column, kind: Column, stem: Column, images: Column, options: Column, answer: Column) -> Column:
    """A question as Markdown: heading, stem, images, options, answer."""

    def links(paths: Column) -> Column:
        return F.array_join(F.transform(paths, lambda p: F.concat(F.lit("\n![]("), p, F.lit(")"))), "")

    shown = F.array_join(F.transform(options, lambda o: F.concat(F.lit("\n- ("), o["label"], F.lit(") "), o["text"], links(o["images"]))), "")
    said = F.when(answer.isNull(), "").when(kind == "numerical", F.concat(F.lit("\n\n**Answer:** "), answer)).otherwise(F.concat(F.lit("\n\n**Answer:** ("), answer, F.lit(")")))
    return F.concat(F.lit("### Q"), number.cast("string"), F.lit("\n\n"), stem, links(images), F.when(F.size(options) > 0, F.concat(F.lit("\n"), shown)).otherwise(""), said, F.lit("\n"))


def markdown_documents(questions: DataFrame) -> DataFrame:
    one = markdown(F.col("question_number"), F.col("question_type"), F.col("stem_text"), F.col("stem_images"), F.col("options"), F.col("answer"))
    rows = F.sort_array(F.collect_list(F.struct("question_number", one.alias("m"))))
    return questions.groupBy("document_id").agg(F.array_join(F.transform(rows, lambda r: r["m"]), "\n").alias("markdown"))


def zip_folder(folder: str, target: str) -> str:
    """A folder of exports as one archive, on the driver: a download for one person."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                path = os.path.join(base, name)
                if os.path.abspath(path) != os.path.abspath(target):
                    z.write(path, os.path.relpath(path, folder))
    return target


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """New rows of a table; ``by`` names partition columns of few values."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def lookup(table: DataFrame, **equal) -> DataFrame:
    """Rows by key; the filters reach the scan."""
    for name, value in equal.items():
        table = table.where(F.col(name) == value)
    return table
