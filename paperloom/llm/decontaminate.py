"""Benchmark decontamination by template and verbatim windows, in DataFrame functions alone.

Numbers, units after numbers and names within sentences become typed placeholders; case and
punctuation go. Names of word strings double (1, 2, 4 words, then two overlapping fours), so that a
window's hash costs four steps a word. Windows of documents and benchmark items are hash-joined.
Windows on one diagonal (the same shift between item and document) are a passage; its slots
must be filled consistently: wherever the item repeats a number or a name, the document repeats the
one that stands for it. That tells a question asked again with other numbers from a text of
the same pattern.

Whether an item's first word is a name can't be seen in the item, as that hangs on what stands before it: its
first window is searched for both ways, and as a name the word itself must be the same.

Verbatim windows are made of all runs of letters and digits, in lower case, without placeholders, so neither
case, punctuation nor what stands around a copy changes them.

A document leaks an item if ``LEAST`` of the item's template windows (all, if it has fewer), on
consistent diagonals, are in it: 13 words in a row. Template windows with more than ``SLOTS``
placeholders say too little and are not used. It also leaks an item whose words it holds from the first
to the last, whatever their number, and one of which it holds ``LEAST`` verbatim windows (all, if fewer),
unless slots of a passage of the two contradict each other.

Scripts without spaces (Han, kana, Thai, Lao, Khmer, Burmese) are cut into characters, which count as words.

Defined results: null texts are empty; an item is a pair of item_id (which may be null) and text, and rows that
repeat it count once; items below ``SHORTEST`` words are searched for verbatim only, items without letters and digits
not at all; items below ``WINDOW`` words are one window; rows repeating id and text are found as one. Benchmark
windows are broadcast up to ``BROADCAST_ROWS`` of them, counted first, and shuffled beyond. Texts of any length are taken
whole; where a document holds an item several times, its best passage counts; empty tables give empty results; further
columns, whatever their names, play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, row_name, stored, work_dir

WINDOW, SHORTEST, SLOTS, LEAST = 8, 5, 4, 6
#: Rows of some 100 bytes: 20 MB at most.
BROADCAST_ROWS = 200_000
# Units that follow a number, and numbers in words.
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|percent|usd|eur|dollars|euros|cents|miles|meters|metres|feet|inches|liters|litres|grams|degrees|hz|v|w|kw|j|n|pa|mol"
WORD_NUMBERS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
_FIRST = "".join(sorted({w[0] for w in WORD_NUMBERS.split("|")}))
_NUM, _UNIT, _NAME = "\u0001", "\u0002", "\u0003"
# Scripts without spaces; the prolonged sound marks belong to no script. Looking a script up is slow, so blocks
# of characters that hold these scripts, and others, say which texts are looked through.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\uFF70\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}&&[^\p{M}]]\p{M}*"
_BLOCKS = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u19FF\u2E80-\uABFF\uF900-\uFAFF\uFF66-\uFF9F\x{11000}-\x{3FFFF}]"


def _cut(text: Column) -> Column:
    """Spaces around the characters of scripts without spaces."""
    text = F.coalesce(text, F.lit(""))
    rare = (F.octet_length(text) > F.length(text)) & text.rlike(_BLOCKS)
    return F.when(rare, F.regexp_replace(text, f"({_UNSPACED})", " $1 ")).otherwise(text)


def tagged_words(text: Column) -> Column:
    """Words without case and punctuation; numbers, units and names begin with their tag.

    Patterns begin with a space, classes with the letters that most texts are made of, and nothing is replaced by itself: so they are fast.
    """
    s = F.regexp_replace(F.concat(F.lit(" "), _cut(text), F.lit(" ")), "[\\t-\\r\u0001-\u0003]", " ")
    s = F.regexp_replace(s, " {2,}", " ")
    s = F.regexp_replace(s, r" (?<=[a-z\d,;\p{Ll}] )([A-Z\p{Lu}][a-z\p{L}]+)", f" {_NAME}$1")
    s = F.lower(s)
    s = F.regexp_replace(s, rf" (?=[\d{_FIRST}\p{{Ps}}\p{{Sc}}+-])[\p{{Ps}}\p{{Sc}}+-]*(\d+(?:[.,:/-]\d+)*|(?:{WORD_NUMBERS})(?= ))%?(?: ?({UNITS}))?(?=[^\p{{L}}\d]* )", f"  {_NUM}$1 {_UNIT}$2")
    s = F.regexp_replace(s, f"{_UNIT}(?![a-z])", "")
    s = F.regexp_replace(s, r"[^a-z \d\p{L}\p{M}\p{N}\u0001-\u0003]+", "")
    return F.array_remove(F.split(s, " "), "")


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case, whatever stands around them."""
    return F.array_remove(F.split(F.lower(_cut(text)), r"[^a-z0-9\p{L}\p{M}\p{N}]+"), "")


def template(words: Column) -> Column:
    """Hash of each word; placeholders by their tag alone."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w < "\u0004", F.substring(w, 1, 1)).otherwise(w)))


def _doubled(names: Column, step: int) -> Column:
    """Names at a position and ``step`` after it, joined."""
    n = F.greatest(F.size(names) - step, F.lit(0))
    return F.zip_with(F.slice(names, F.lit(1), n), F.slice(names, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _chains(rows: DataFrame, words: str, verbatim: bool) -> DataFrame:
    """Adds w1, w2, w4: a name for each one, two, four words. Each step is used twice, so Spark keeps it apart."""
    rows = rows.withColumn("w1", F.transform(words, lambda w: F.xxhash64(w)) if verbatim else template(F.col(words)))
    rows = rows.withColumn("w2", _doubled(F.col("w1"), 1))
    return rows.withColumn("w4", _doubled(F.col("w2"), 2))


def _step(size: int) -> int:
    """Words of the two names that overlap in a window."""
    return 4 if size >= 4 else 2 if size >= 2 else 1


def _window(a: Column, b: Column, size: Column, verbatim: bool) -> Column:
    return F.xxhash64(a, b, -size if verbatim else size)


def _windows(items: DataFrame, verbatim: bool) -> DataFrame:
    """The windows of items (item, item_id, words, first: the first word is taken for a name)."""
    items = _chains(items, "words", verbatim).withColumn("size", F.least(F.size("words"), F.lit(WINDOW)))
    last = F.when(F.col("first"), 0).otherwise(F.size("words") - F.col("size"))
    rows = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), last)))

    def ends(step: int) -> Column:
        return F.struct(F.get(f"w{step}", F.col("item_at")).alias("a"), F.get(f"w{step}", F.col("item_at") + F.col("size") - step).alias("b"))

    rows = rows.withColumn("e", F.when(F.col("size") >= 4, ends(4)).when(F.col("size") >= 2, ends(2)).otherwise(ends(1)))
    key = _window(F.col("e.a"), F.col("e.b"), F.col("size"), verbatim)
    return rows.select("item", "item_id", F.lit(verbatim).alias("verbatim"), "first", "size", "item_at", key.alias("key"), F.slice("words", F.col("item_at") + 1, F.col("size")).alias("item_words"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item, item_id, verbatim, first, size, item_at, key, item_words, total: usable windows of each item."""
    own = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    no = F.lit(False).alias("first")
    plain = own.select("item", "item_id", plain_words(F.col("text")).alias("words"), no).where(F.size("words") > 0)
    tagged = own.select("item", "item_id", tagged_words(F.col("text")).alias("words"), no, tagged_words(F.concat(F.lit("a, "), F.col("text"))).alias("after")).where(F.size("words") >= SHORTEST)
    named = tagged.select("item", "item_id", F.slice("after", F.lit(2), F.size("words")).alias("words"), F.lit(True).alias("first")).where(F.get("words", F.lit(0)).startswith(_NAME))
    templates = _windows(tagged.drop("after").unionByName(named), False)
    templates = templates.where(F.size(F.filter("item_words", lambda w: w < "\u0004")) - F.col("first").cast("int") <= SLOTS)
    rows = templates.unionByName(_windows(plain, True))
    totals = rows.groupBy("item", "verbatim").agg(F.count_distinct("item_at").cast("int").alias("total"))
    return rows.join(totals, ["item", "verbatim"])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_name(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))


def _fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if counted to be small; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, item_id, n_windows, coverage, exact: documents that hold items of the benchmark.

    A row for each document and item; the windows are the templates', or the verbatim ones where these cover more.
    """
    folder = work_dir(docs.sparkSession)
    items = stored(item_windows(benchmark), folder, "items")
    sizes = [(r["verbatim"], r["size"]) for r in items.select("verbatim", "size").distinct().collect()]  # WINDOW of each kind at most
    keys = _fits(items.select("key", "verbatim", "first", "size", "item", "item_at", "total").withColumnRenamed("key", "item_key"))
    named = _named(docs, id_col, text_col)

    def chained(verbatim: bool) -> DataFrame:
        words = (plain_words if verbatim else tagged_words)(F.col("text"))
        return _chains(named.select("doc_id", "row", words.alias("words")), "words", verbatim)  # a filter would cut the words twice

    def matched(verbatim: bool, sizes: list[int]) -> DataFrame:
        """Windows of all sizes from one pass: behind each other in one list, so a window's place in it tells its place in the text."""
        words, parts = F.size("words"), []

        def joined(size: int):
            return lambda a, b: _window(a, b, F.lit(size), verbatim)

        for size in sizes:
            step = _step(size)
            w, n = F.col(f"w{step}"), F.greatest(words - size + 1, F.lit(0))
            parts.append(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(size - step + 1), n), joined(size)))
        rows = chained(verbatim).select("doc_id", "row", words.alias("n_words"), F.posexplode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("place", "key"))
        found = rows.join(keys.where(F.col("verbatim") == verbatim), F.col("key") == F.col("item_key"))
        before = F.lit(0)
        for i, size in enumerate(sizes):
            ahead = reduce(lambda a, b: a + b, [F.greatest(F.col("n_words") - s + 1, F.lit(0)) for s in sizes[:i]], F.lit(0))
            before = F.when(F.col("size") == size, ahead).otherwise(before)
        return found.select("doc_id", "row", (F.col("place") - before).alias("doc_at"), "item", "item_at", "verbatim", "first", "size", "total")

    empty = docs.sparkSession.createDataFrame([], "doc_id long, row binary, doc_at int, item long, item_at int, verbatim boolean, first boolean, size int, total int")
    kinds = [(v, sorted((s for k, s in sizes if k == v), reverse=True)) for v in sorted({v for v, _ in sizes})]
    found = reduce(DataFrame.unionByName, [matched(*k) for k in kinds]) if kinds else empty
    hits = stored(found.distinct().withColumn("diagonal", F.col("doc_at") - F.col("item_at")), folder, "hits")
    # slots of passages that have any: the words of hit documents, from a second look at those alone
    slotted = items.where(~F.col("verbatim") & F.exists("item_words", lambda w: w < "\u0004")).select("item", "item_at", "first", "item_words")
    asked = stored(hits.where("NOT verbatim").join(_fits(slotted), ["item", "item_at", "first"]), folder, "asked")
    rows = _fits(asked.select("row").distinct())
    texts = stored(named.join(rows, "row").dropDuplicates(["row"]).select("row", tagged_words(F.col("text")).alias("words")), folder, "texts")
    pairs = asked.join(texts, "row").select("row", "item", "diagonal", "first", F.posexplode(F.arrays_zip(F.col("item_words").alias("i"), F.slice("words", F.col("doc_at") + 1, F.col("size")).alias("d"))).alias("at", "p"))
    pairs = pairs.where(F.col("p.i") < "\u0004").select("row", "item", "diagonal", (F.col("first") & (F.col("at") == 0)).alias("edge"), "p.i", "p.d").distinct()
    inner = lambda c: F.when(~F.col("edge"), c)
    slots = pairs.groupBy("row", "item", "diagonal").agg((F.count(inner(F.col("i"))) == F.count_distinct(inner(F.col("i")))).alias("consistent"), F.min(inner(F.col("i") == F.col("d"))).alias("same"), F.min(F.when(F.col("edge"), F.col("i") == F.col("d"))).alias("edge_same"))
    judged = hits.where("NOT verbatim").join(slots, ["row", "item", "diagonal"], "left").withColumn("consistent", F.coalesce("consistent", F.lit(True)))
    torn = judged.where("NOT consistent").select("row", "item").distinct().withColumn("torn", F.lit(True))
    judged = judged.where(F.col("consistent") & (~F.col("first") | F.coalesce("edge_same", F.lit(False))))
    by_template = judged.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.count_distinct("item_at").alias("n_windows"), F.first("total").alias("total"), F.min(F.coalesce("same", F.lit(True))).alias("exact"))
    by_template = by_template.where(F.col("n_windows") >= F.least(F.col("total"), F.lit(LEAST))).withColumn("verbatim", F.lit(False))
    runs = hits.where("verbatim").groupBy("row", "item", "diagonal").agg(F.first("doc_id").alias("doc_id"), F.first("total").alias("total"), F.count("*").alias("n"), F.collect_set("item_at").alias("places"))
    by_words = runs.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"), F.first("total").alias("total"), F.max(F.col("n") == F.col("total")).alias("whole"))
    by_words = by_words.join(torn, ["row", "item"], "left").where(F.col("whole") | (F.col("torn").isNull() & (F.col("n_windows") >= F.least(F.col("total"), F.lit(LEAST)))))
    both = by_template.unionByName(by_words.select("row", "item", "doc_id", "n_windows", "total", F.lit(True).alias("exact"), F.lit(True).alias("verbatim")))
    both = both.withColumn("coverage", F.round(F.col("n_windows") / F.col("total"), 6))
    best = both.groupBy("row", "item").agg(F.max(F.struct("coverage", ~F.col("verbatim"), "n_windows", "exact", "doc_id")).alias("b"))
    ids = _fits(items.select("item", "item_id").distinct())
    return best.join(ids, "item").select("b.doc_id", "row", "item_id", "b.n_windows", "b.coverage", "b.exact")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns and no others."""
    names, (row,) = docs.columns, private(docs, "row")
    found = stored(leaks(docs, benchmark).select(F.col("row").alias(row)).distinct(), work_dir(docs.sparkSession), "found")
    return docs.withColumn(row, row_name("doc_id", "text")).join(_fits(found), row, "left_anti").select(*[F.col(f"`{c}`") for c in names])
