"""Benchmark decontamination with DataFrame functions only.

Benchmark items are cut into windows of consecutive normalised words. The windows' hashes form a
hash set that every task holds; a document's word windows are hashed in place, tested against the
set, and hits are verified on their words. Documents are neither exploded nor shuffled.

Defined results: a null text has no words; an item without words has no window; an item of fewer
than ``window`` words is one window; null item ids are one item, counted but without a name.
Documents may repeat, be null in any column, and carry further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import fresh, stage

WINDOW = 10
# Windows that go to the tasks as a literal hash set. A benchmark with more is joined instead.
SET_LIMIT = 100_000
MAX_HIT_SHARE = 0.5

# Separators between words once A-Z are lower-cased, the same with capitals kept,
# and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised_words(text: Column) -> Column:
    """Lower-case A-Z only, then the runs between separators; null gives no words."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes other letters too, so it serves only where every character is one byte.
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


def windows_of(benchmark: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(length, hash, ends, words, items): each distinct window with the items that hold it."""
    words = benchmark.select(
        F.col(item).cast("string").alias("item"), normalised_words(F.col(text)).alias("w")
    ).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = words.withColumn("length", length).select(
        "item",
        "length",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("length") + 1),
                lambda i: F.slice("w", i, F.col("length")),
            )
        ).alias("w"),
    )
    ends = F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.col("length") - 1))
    return cut.groupBy(
        "length",
        F.xxhash64("w").alias("hash"),
        ends.alias("ends"),
        F.array_join("w", " ").alias("words"),
    ).agg(F.sort_array(F.flatten(F.collect_set(F.array("item")))).alias("items"))  # nulls too


def _longs(values: list[int]) -> list[str]:
    return [f"{v}L" if v != -(2**63) else f"({v + 1}L - 1L)" for v in values]


def _literal_hits(words: str, found: list) -> Column:
    """Verified hits of a row as an array of (pos, length), tested against literal sets."""
    parts = []
    for length in sorted({r.length for r in found}):
        mine = [r for r in found if r.length == length]
        ends = sorted({r.ends for r in mine})
        texts = ["'" + r.words + "'" for r in mine]  # words hold no quotes or backslashes
        start = f"sequence(0, size({words}) - {length})"
        cut = f"slice({words}, i + 1, {length})"
        # From the cheapest test to the verification: outer words, all words hashed, all words.
        tests = (
            (f"xxhash64(get({words}, i), get({words}, i + {length - 1}))", _longs(ends)),
            (f"xxhash64({cut})", _longs([r.hash for r in mine])),
            (f"array_join({cut}, chr(32))", texts),
        )
        spots = start
        for value, members in tests:
            spots = f"filter({spots}, i -> {value} IN ({','.join(members)}))"
        parts.append(
            f"CASE WHEN size({words}) >= {length} THEN transform({spots}, "
            f"i -> struct(i AS pos, {length} AS length)) "
            f"ELSE CAST(array() AS array<struct<pos:int,length:int>>) END"
        )
    if not parts:
        return F.expr("CAST(array() AS array<struct<pos:int,length:int>>)")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _joined_hits(docs: DataFrame, words: str, hits: str, windows: DataFrame) -> DataFrame:
    """The same hits for a benchmark too large for a literal: windows are hash-joined."""
    row = fresh(docs, "_row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    lengths = [r.length for r in windows.select("length").distinct().collect()]  # <= window rows

    def spots(length: int) -> Column:
        every = F.transform(
            F.sequence(F.lit(0), F.size(words) - length),
            lambda i: F.struct(
                i.alias("pos"), F.lit(length).alias("length"),
                F.xxhash64(F.slice(words, i + 1, length)).alias("hash"),
            ),
        )
        none = F.array().cast("array<struct<pos:int,length:int,hash:bigint>>")
        return F.when(F.size(words) >= length, every).otherwise(none)

    parts = [spots(length) for length in lengths]
    cut = docs.select(row, F.explode(F.concat(*parts)).alias("c")).select(row, "c.*")
    found = (
        cut.join(windows.select("length", "hash", "words"), ["length", "hash"])
        .groupBy(row)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "length", "words"))).alias(hits))
    )
    same = F.filter(
        hits, lambda h: F.array_join(F.slice(words, h["pos"] + 1, h["length"]), " ") == h["words"]
    )
    verified = F.transform(same, lambda h: F.struct(h["pos"], h["length"]))
    empty = F.array().cast("array<struct<pos:int,length:int>>")
    return (
        docs.join(found, row, "left")
        .withColumn(hits, F.coalesce(verified, empty))
        .drop(row)
    )


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, whatever filters and uses come after.

    Filters on a plain column would be pushed below it and repeat its expression inside lambdas.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def with_hits(
    docs: DataFrame, text: str, windows: DataFrame, words: str, hits: str,
    set_limit: int = SET_LIMIT,
) -> DataFrame:
    """Add ``words`` (normalised) and ``hits``, the sorted (pos, length) of every occurrence."""
    docs = _computed(docs, {words: normalised_words(F.col(f"`{text}`"))})
    found = windows.select("length", "hash", "ends", "words").limit(set_limit + 1).collect()
    if len(found) <= set_limit:
        return _computed(docs, {hits: _literal_hits(words, found)})
    return _joined_hits(docs, words, hits, windows)


def words_hit(hits: str) -> Column:
    """Number of words inside the union of sorted hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, hit: Column) -> Column:
        end = hit["pos"] + hit["length"]
        gain = F.greatest(F.lit(0), end - F.greatest(seen["end"], hit["pos"]))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + gain).alias("n"))

    return F.aggregate(hits, start, add, lambda seen: seen["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item: str = "item_id", window: int = WINDOW, set_limit: int = SET_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, the sorted ``items`` that occur in it, and
    n_items, their number with the item of null id."""
    windows = windows_of(benchmark, item, text, window)
    scanned = with_hits(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
        "text", windows, "_words", "_hits", set_limit,
    )
    window_text = F.transform(
        "_hits", lambda h: F.array_join(F.slice("_words", h["pos"] + 1, h["length"]), " ")
    )
    scanned = scanned.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        words_hit("_hits").alias("n_hit"),
        F.array_distinct(window_text).alias("found"),
        F.monotonically_increasing_id().alias("_row"),
    )
    scanned = stage(scanned, "contamination")
    items = (
        scanned.filter("n_hit > 0")
        .select("_row", F.explode("found").alias("words"))
        .join(windows.select("words", "items"), "words")
        .groupBy("_row")
        .agg(F.collect_set("items").alias("sets"))
        .select("_row", F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    every = F.coalesce("items", none)
    return scanned.join(items, "_row", "left").select(
        "doc_id", "n_words", "n_hit",
        F.array_compact(every).alias("items"), F.size(every).cast("long").alias("n_items"),
    )


def _kept_runs(hits: str, n_words: Column) -> Column:
    """Runs (first, last + 1) of words outside of the sorted hits."""
    run = "array<struct<first:int,stop:int>>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(run).alias("runs"))

    def add(seen: Column, hit: Column) -> Column:
        one = F.array(F.struct(seen["end"].alias("first"), hit["pos"].alias("stop")))
        runs = F.when(hit["pos"] > seen["end"], F.concat(seen["runs"], one)).otherwise(seen["runs"])
        end = F.greatest(seen["end"], hit["pos"] + hit["length"])
        return F.struct(end.alias("end"), runs.alias("runs"))

    def close(seen: Column) -> Column:
        last = F.array(F.struct(seen["end"].alias("first"), n_words.alias("stop")))
        return F.concat(seen["runs"], last)

    return F.aggregate(hits, start, add, close)


def without_hits(text: Column, hits: str) -> Column:
    """``text`` without its hit words; each kept word keeps what stands before it."""
    cased = F.filter(F.split(text, CASED_SEPARATORS), lambda w: w != "")
    gaps = F.regexp_extract_all(
        F.concat(F.lit(" "), text, F.lit(" ")), F.lit(CASED_SEPARATORS), F.lit(0)
    )
    # One more gap than words: the last piece is what follows the last word.
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), cased.alias("word")),
        lambda z: F.concat(z["gap"], F.coalesce(z["word"], F.lit(""))),
    )
    # Bound as a lambda's argument, the pieces are made once and not once per run.
    joined = F.transform(
        F.array(pieces),
        lambda p: F.array_join(
            F.flatten(
                F.transform(
                    _kept_runs(hits, F.size(p)),
                    lambda r: F.slice(p, r["first"] + 1, r["stop"] - r["first"]),
                )
            ),
            "",
        ),
    )
    return F.trim(F.get(joined, F.lit(0)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_hit_share: float = MAX_HIT_SHARE,
    set_limit: int = SET_LIMIT,
) -> DataFrame:
    """Documents with benchmark passages cut out; columns and clean rows stay as they are.

    A document with more than ``max_hit_share`` of its words hit is dropped whole.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    words, hits, n_hit = fresh(docs, "_words"), fresh(docs, "_hits"), fresh(docs, "_n_hit")
    windows = windows_of(benchmark, item, item_text, window)
    scanned = with_hits(docs, text, windows, words, hits, set_limit)
    scanned = _computed(scanned, {n_hit: words_hit(hits)})
    kept = scanned.filter(F.col(n_hit) <= F.size(words) * F.lit(max_hit_share))
    cleaned = F.when(F.col(n_hit) == 0, F.col(f"`{text}`")).otherwise(
        without_hits(F.col(f"`{text}`"), hits)
    )
    return kept.withColumn(text, cleaned).select(*columns)
