"""Page decoders and detectors as plug-ins.

A decoder turns a file's bytes into rows of the layout tables, a detector a page into regions. Both
are plain Python objects; Spark runs them over Arrow batches, and a page that fails becomes a row
with its error and doesn't stop the others.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators.vision import REGION, mock_layout
from .pdf import PdfDecoder


class Decoder(Protocol):
    """Gives (kind, row) for each row of each layout table."""

    def decode(self, document_id: str, content: bytes) -> Iterator[tuple[str, dict]]: ...


class Detector(Protocol):
    """``detect_again(document_id, page_number, reason, first)`` may be there too: a second look that knows the first regions."""

    def detect_layout(self, document_id: str, page_number: int) -> dict: ...

    def transcribe_region(self, path: str) -> dict: ...


_DECODERS: dict[str, Callable[[], Decoder]] = {"pdf": PdfDecoder}
_DETECTORS: dict[str, Callable[[], Detector]] = {}


def register_decoder(name: str, make: Callable[[], Decoder]) -> None:
    _DECODERS[name] = make


def register_detector(name: str, make: Callable[[], Detector]) -> None:
    _DETECTORS[name] = make


def _named(table: dict, name: str):
    if name not in table:
        raise KeyError(f"nothing is registered as {name!r}")
    return table[name]


class Retrying:
    """Tries a detector, again with a growing pause, then the fallback, whose answer says so."""

    def __init__(self, primary: Detector, fallback: Detector | None = None, retries: int = 2, backoff_s: float = 2.0, sleep=time.sleep):
        self.primary, self.fallback, self.retries, self.backoff_s, self.sleep = primary, fallback, retries, backoff_s, sleep

    def _try(self, call):
        for attempt in range(self.retries + 1):
            try:
                return call(self.primary)
            except Exception as e:  # noqa: BLE001  any failure counts
                error = e
                if attempt < self.retries:
                    self.sleep(self.backoff_s * (attempt + 1))
        if self.fallback is None:
            raise error
        out = call(self.fallback)
        return out | {"warnings": [f"the primary detector failed ({error}); the fallback answered", *out.get("warnings", [])]}

    def detect_layout(self, document_id: str, page_number: int) -> dict:
        return self._try(lambda d: d.detect_layout(document_id, page_number))

    def detect_again(self, document_id: str, page_number: int, reason: str, first: list[dict]) -> dict:
        return self._try(lambda d: _again(d, document_id, page_number, reason, first))

    def transcribe_region(self, path: str) -> dict:
        return self._try(lambda d: d.transcribe_region(path))


def _again(detector: Detector, document_id: str, page_number: int, reason: str, first: list[dict]) -> dict:
    if hasattr(detector, "detect_again"):
        return detector.detect_again(document_id, page_number, reason, first)
    return detector.detect_layout(document_id, page_number)


class Mock:
    """Detects nothing and reads nothing; ``detect`` makes its layouts without Python."""

    def detect_layout(self, document_id: str, page_number: int) -> dict:
        return {"warnings": ["mock layout: nothing was detected"], "regions": [], "reading_order": []}

    def transcribe_region(self, path: str) -> dict:
        return {"text": None, "latex": None, "unreadable": True}


_DETECTORS["mock"] = Mock


def provider(config: Config) -> str:
    """The name under which the configured detector is registered, with retries and, where one is named, its fallback."""
    if config.vision_provider == "mock":
        return "mock"
    primary = _named(_DETECTORS, config.vision_provider)
    fallback = _DETECTORS.get(config.vision_fallback)  # without one the primary stands alone
    name = f"{config.vision_provider}+{config.vision_fallback or 'none'}"
    register_detector(name, lambda: Retrying(primary(), fallback() if fallback else None, config.vision_retries, config.vision_backoff_s))
    return name


LAYOUT_TABLES = {
    "pages": "document_id string, page_number int, width_pt double, height_pt double, rotation int, text string, drawing_count int",
    "spans": "document_id string, page_number int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double",
    "chars": "document_id string, page_number int, block_no int, line_no int, span_no int, char_no int, c string, x0 double, y0 double",
    "words": "document_id string, page_number int, block_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double",
    "images": "document_id string, page_number int, image_no int, x0 double, y0 double, x1 double, y1 double",
}


def decode(files: DataFrame, decoder: str) -> DataFrame:
    """document_id, kind (a layout table, or ``error``), row (JSON) for each admitted file (document_id, content)."""
    make = _named(_DECODERS, decoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for frame in frames:
            for document_id, content in zip(frame["document_id"], frame["content"], strict=True):
                try:
                    rows = [(document_id, kind, json.dumps(row)) for kind, row in own.decode(document_id, bytes(content))]
                except Exception as e:  # noqa: BLE001  one file's failure is that file's
                    rows = [(document_id, "error", str(e))]
                for at in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[at : at + 5000], columns=["document_id", "kind", "row"])

    return files.select("document_id", "content").mapInPandas(run, "document_id string, kind string, row string")


def layout_table(decoded: DataFrame, kind: str) -> DataFrame:
    """One of LAYOUT_TABLES from decoded rows."""
    return decoded.where(F.col("kind") == kind).select(F.from_json("row", LAYOUT_TABLES[kind]).alias("r")).select("r.*")


def detect(pages: DataFrame, detector: str = "mock", concurrency: int | None = None) -> DataFrame:
    """Layouts of pages; ``error`` says why a page has none.

    ``concurrency`` bounds the tasks, where the detector bears no more at a time. Rows with a ``reason`` (and ``first``, the
    first regions as JSON) are looked at again.
    """
    if detector == "mock":
        return mock_layout(pages).withColumn("error", F.lit(None).cast("string"))
    make, second = _named(_DETECTORS, detector), "reason" in pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for frame in frames:
            for given in frame.to_dict("records"):
                document_id, page = given["document_id"], int(given["page_number"])
                row = {"document_id": document_id, "page_number": page, "served_by": detector, "warnings": [], "regions": [], "reading_order": [], "error": None}
                try:
                    row |= _again(own, document_id, page, given["reason"], json.loads(given["first"] or "[]")) if second else own.detect_layout(document_id, page)
                except Exception as e:  # noqa: BLE001  one page's failure is that page's
                    row |= {"error": str(e), "warnings": [f"detect_layout failed: {e}"]}
                yield pd.DataFrame([row])

    schema = f"document_id string, page_number int, served_by string, warnings array<string>, regions array<{REGION}>, reading_order array<string>, error string"
    width = concurrency or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pages.select("document_id", "page_number", *(["reason", "first"] if second else []))
    return asked.repartition(width, "document_id", "page_number").mapInPandas(run, schema)


def transcribe(crops: DataFrame, detector: str = "mock", concurrency: int | None = None) -> DataFrame:
    """path -> path, new_text, new_latex (null where unreadable) and error."""
    make = _named(_DETECTORS, detector)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for frame in frames:
            for path in frame["path"]:
                row = {"path": path, "new_text": None, "new_latex": None, "error": None}
                try:
                    read = own.transcribe_region(path)
                    row |= {} if read.get("unreadable") else {"new_text": read.get("text"), "new_latex": read.get("latex")}
                except Exception as e:  # noqa: BLE001  one crop's failure is that crop's
                    row["error"] = str(e)
                yield pd.DataFrame([row])

    width = concurrency or int(crops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return crops.select("path").distinct().repartition(width, "path").mapInPandas(run, "path string, new_text string, new_latex string, error string")
