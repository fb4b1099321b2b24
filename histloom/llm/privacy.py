"""Personal data: pattern matches plus terms that give protected entities away.

Every e-mail address, IP address, card and phone number found by pattern is a protected entity.
The words near its occurrences are counted over the whole corpus. A term discloses an entity when
knowing the term makes the entity likely and is far more informative than chance:

    p(entity | term) = texts with the term near the entity / texts with the term   >= ``GENERALISE``
    information      = log2(p(entity | term) / p(entity))                          >= ``MIN_BITS``
    texts with the term near the entity                                            >= ``SUPPORT``

All counts, p(entity) too, are of different texts: copies of a text count once, so they neither prove
nor hide anything. Such terms are generalised wherever they stand, to the kind of entity they tell
most about (``GENERAL``), and removed from ``REMOVE`` on.
Spans are code points, end exclusive.

Defined results: a null text is empty and has no spans; equal rows have equal results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import by_value, fresh, stage

by_value(__name__)

CONTEXT_WORDS = 8
SUPPORT = 3
GENERALISE = 0.5
REMOVE = 0.9
MIN_BITS = 3.0
# Terms that tasks hold as a dictionary; with more, words are joined with the terms.
TERM_LIMIT = 200_000

# Kinds in their order, and the patterns of personal data.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting inside a run of digits cannot succeed where its first digit failed.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
# What a term is generalised to: the kind of entity it tells most about.
GENERAL = {kind: f"[{kind.upper()} CONTEXT]" for kind in KINDS}

Span = tuple[int, int, int]  # start, index of the kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # A match may end inside what would be a longer address, so look from its end on.
    at = 0
    while found := IP.search(text, at):
        parts = [p.lstrip("0") or "0" for p in found[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield found.span()
        at = found.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _numbers(text: str, pattern: re.Pattern, fits: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    for found in pattern.finditer(text):
        if fits("".join(DIGIT.findall(found[0]))):
            yield found.span()


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind."""
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        spans += [(a, 1, b) for a, b in _ips(text)]
        spans += [
            (a, 2, b) for a, b in _numbers(text, CARD, lambda d: 12 <= len(d) <= 19 and luhn(d))
        ]
        if "+" in text:
            spans += [(a, 3, b) for a, b in _numbers(text, PHONE, lambda d: 9 <= len(d) <= 15)]
    return sorted(spans)


def term_spans(text: str, terms: dict[str, str], taken: list[Span]) -> list[Span]:
    """Disclosing words outside of ``taken``."""
    if not terms:
        return []
    found = [m.span() for m in TERM.finditer(text) if m[0].casefold() in terms]
    return [(a, len(KINDS), b) for a, b in _outside(found, taken)]


def _outside(found: list[tuple[int, int]], taken: list[Span]) -> list[tuple[int, int]]:
    """The ``found`` that overlap no span of ``taken``; both by start, compared in one walk."""
    free, i, reach = [], 0, 0
    for start, end in found:
        # Spans of several kinds may overlap: the furthest end of those begun so far counts.
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][2])
            i += 1
        if reach <= start:
            free.append((start, end))
    return free


def _near(text: str, spans: list[Span]) -> set[tuple[int, str | None]]:
    """(entity, term) of the nearest words on either side of each span; term null for the entity."""
    found: set[tuple[int, str | None]] = set()
    # Whole words of the whole text, whatever stands between them and the span.
    words = [m.span() for m in TERM.finditer(text)] if spans else []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    for start, kind, end in spans:
        first, last = bisect_right(ends, start), bisect_left(starts, end)
        near = words[max(0, first - CONTEXT_WORDS) : first] + words[last : last + CONTEXT_WORDS]
        # The last bits of an entity's hash are its kind.
        entity = _hash64(f"{KINDS[kind]}:{text[start:end].casefold()}") & -len(KINDS) | kind
        found.add((entity, None))
        found.update((entity, text[a:b].casefold()) for a, b in near)
    return found


def _hash64(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63


def contexts(docs: DataFrame, text: str) -> DataFrame:
    """(body, entity, term), body being the text's hash: a row for every text, for every entity of
    a text (term null), and for every word near one."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(0):
                body = body.as_py() or ""
                digest = _hash64(body)
                rows.append((digest, None, None))
                rows += [(digest, *found) for found in _near(body, base_spans(body))]
            kinds = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["body", "entity", "term"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(
        near, "body bigint, entity bigint, term string"
    )


def _words(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, term, start, end) of every word; only for term lists too large to send around."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(m[0].casefold(), *m.span()) for m in TERM.finditer(body.as_py() or "")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(found), pa.int64()),
                     pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.int32()),
                     pa.array([f[2] for f in found], pa.int32())],
                    names=["row", "term", "start", "end"],
                )

    narrow = docs.select(F.col(row).alias("row"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(cut, "row bigint, term string, start int, end int")


def _texts_with(docs: DataFrame, text: str, terms: DataFrame, limit: int) -> DataFrame:
    """(term, texts): in how many different texts of the corpus each term stands."""
    listed = [r.term for r in terms.limit(limit + 1).collect()]
    narrow = docs.select(F.col(f"`{text}`").alias("text"))
    if len(listed) > limit:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(0):
                    body = body.as_py() or ""
                    here = sorted({w.casefold() for w in set(TERM.findall(body))})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_hash64(body)] * len(here), pa.int64()), pa.array(here, pa.string())],
                        names=["body", "term"],
                    )

        pairs = narrow.mapInArrow(cut, "body bigint, term string").join(terms, "term").distinct()
        return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    wanted = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(listed)})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The texts that this task has seen; copies in other tasks meet by their hash.
        seen: set[int] = set()
        for batch in batches:
            bodies, found = [], []
            for body in batch.column(0):
                body = body.as_py() or ""
                digest = _hash64(body)
                if digest in seen:
                    continue
                seen.add(digest)
                here = {w.casefold() for w in set(TERM.findall(body))} & wanted.value.keys()
                if here:
                    bodies.append(digest)
                    found.append([wanted.value[w] for w in here])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bodies, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["body", "places"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(wanted.value)
        sums = np.zeros(len(names), np.int64)
        for batch in batches:
            places = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            sums += np.bincount(places, minlength=len(names))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in some], pa.string()), pa.array(sums[some])],
            names=["term", "n"],
        )

    once = narrow.mapInArrow(find, "body bigint, places array<int>").groupBy("body")
    partial = once.agg(F.first("places").alias("places")).select("places")
    partial = partial.mapInArrow(count, "term string, n bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("texts"))


def disclosing_terms(docs: DataFrame, text: str = "text", support: int = SUPPORT,
                     limit: int = TERM_LIMIT) -> DataFrame:
    """(term, action, mask): every term over the thresholds, with ``remove`` or ``generalise`` and
    what takes its place. Of entities as likely, the first kind in the order of KINDS names it."""
    # An entity may hold a third of all texts: all counts combine before they move.
    once = stage(contexts(docs, text).distinct(), "contexts")
    total = once.filter("entity IS NULL").count()
    # Even a sure term of an entity in more texts than that has too few bits.
    most = total / 2**MIN_BITS
    frequent = (
        once.filter("entity IS NOT NULL AND term IS NULL").groupBy("entity")
        .agg(F.count(F.lit(1)).alias("of_entity"))
        .filter((F.col("of_entity") >= support) & (F.col("of_entity") <= most))
    )
    pairs = (
        once.filter("term IS NOT NULL").groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("both"))
        .filter(F.col("both") >= support).join(frequent, "entity")
    )
    pairs = stage(pairs, "term-pairs")
    terms = stage(pairs.select("term").distinct(), "terms")
    if terms.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, action string, mask string")
    spread = _texts_with(docs, text, terms, limit)
    likely = F.col("both") / F.col("texts")
    bits = F.log2(likely * F.lit(float(total)) / F.col("of_entity"))
    action = F.when(F.col("likely") >= REMOVE, "remove").otherwise("generalise")
    general = F.get(F.array(*[F.lit(GENERAL[k]) for k in KINDS]), F.col("kind"))
    return stage(
        pairs.join(spread, "term")
        .withColumns({"likely": likely, "bits": bits})
        .filter((F.col("likely") >= GENERALISE) & (F.col("bits") >= MIN_BITS))
        .withColumn("kind", F.expr(f"int(entity & {len(KINDS) - 1})"))
        .groupBy("term")
        .agg(F.max("likely").alias("likely"), F.min_by("kind", F.struct(-F.col("likely"), "kind")).alias("kind"))
        .select("term", action.alias("action"), F.when(action == "remove", "").otherwise(general).alias("mask")),
        "disclosing",
    )


def _text(spans: list[Span]) -> str:
    names = (*KINDS, "term")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def _with_terms(docs: DataFrame, text: str, terms: DataFrame, limit: int):  # noqa: ANN202
    """(frame, column of given term spans, dictionary): one of the last two holds the terms."""
    given = fresh(docs, "_terms")
    empty = F.array().cast("array<struct<start:int,end:int,mask:string>>")
    listed = terms.limit(limit + 1).collect()
    if len(listed) <= limit:
        return docs.withColumn(given, empty), given, {r.term: r.mask for r in listed}
    row = fresh(docs, "_row")
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    found = (
        _words(kept, row, text).join(terms, "term").groupBy(F.col("row").alias(row))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "mask"))).alias(given))
    )
    joined = kept.join(found, row, "left").withColumn(given, F.coalesce(given, empty))
    return joined.drop(row), given, {}


def _all_spans(body: str, given: list[dict], terms: dict[str, str]) -> tuple[list[Span], list[Span]]:
    base = base_spans(body)
    more = term_spans(body, terms, base)
    listed = sorted((g["start"], g["end"]) for g in given)
    more += [(a, len(KINDS), b) for a, b in _outside(listed, base)]
    return base, sorted(base + more)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  limit: int = TERM_LIMIT) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base (text of base spans), spans."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    narrow, given, terms = _with_terms(narrow, "text", disclosing_terms(narrow, limit=limit), limit)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, spans = [[] for _ in KINDS], [], []
            for body, terms_here in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                base, every = _all_spans(body.as_py() or "", terms_here, terms)
                for i, column in enumerate(counts):
                    column.append(sum(k == i for _, k, _ in base))
                bases.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array(bases, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    id_type = narrow.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return narrow.select("doc_id", "text", given).mapInArrow(
        scan, f"doc_id {id_type}, {counts}, base_sha256 string, spans string"
    )


def masked(body: str, spans: list[Span], mask: Callable[[int, int], str]) -> str:
    """``body`` with spans replaced, terms by their ``mask``; of overlapping spans the first one's
    mask stands for all."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out.append(body[done:start])
            out.append(mask(start, end) if kind == len(KINDS) else MASKS[KINDS[kind]])
        done = max(done, end)
    return "".join([*out, body[done:]])


def sanitise(docs: DataFrame, text: str = "text", limit: int = TERM_LIMIT) -> DataFrame:
    """All rows and columns, with personal data and disclosing terms masked in ``text``."""
    columns = docs.columns
    terms_frame = disclosing_terms(docs, text, limit=limit)
    marked, given, terms = _with_terms(docs, text, terms_frame, limit)

    def clean(body: str | None, terms_here: list) -> str | None:
        if body is None:
            return None
        terms_here = [t if isinstance(t, dict) else t.asDict() for t in terms_here]
        _, spans = _all_spans(body, terms_here, terms)
        if not spans:
            return body
        told = {(t["start"], t["end"]): t["mask"] for t in terms_here}
        return masked(body, spans, lambda a, b: told[a, b] if told else terms[body[a:b].casefold()])

    udf = F.udf(clean, "string", useArrow=True)
    return marked.withColumn(text, udf(F.col(f"`{text}`"), F.col(given))).select(
        *[F.col(f"`{c}`") for c in columns]
    )
