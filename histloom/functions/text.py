"""Scalar text and path expressions. Every helper takes and returns a Column; no Python UDF.

Whitespace, word and line-break classes are spelled out because the JVM's ``\\s`` and ``\\w`` are
ASCII-only by default.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv

_WS_LIST = tuple(fv.WHITESPACE_CHARS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times.

    The optimizer inlines a projected column into every lambda that mentions it, so a costly
    expression would run once per array element. A lambda over a one-element array does not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(fv.WHITESPACE_CHARS))


def words(text: Column) -> Column:
    """Whitespace-separated tokens; empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{fv.WS}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of whitespace-separated tokens; 0 for null. No per-token lambda."""
    text = F.coalesce(text, F.lit(""))
    edges = F.left(text, F.lit(1)).isin(*_WS_LIST).cast("int") + F.right(text, F.lit(1)).isin(
        *_WS_LIST
    ).cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, f"[{fv.WS}]+")) - edges)


def words_up_to(text: Column, n: int) -> Column:
    """``count_words(text)`` where that is less than ``n``, else some number of at least ``n``.

    The beginning of a text mostly has that many words already; the rest is then not looked at.
    """
    n_first = count_words(F.left(text, F.lit(16 * max(n, 0) + 64)))
    return F.when(n_first >= n, n_first).otherwise(count_words(text))


def fewer_words_than(text: Column, n: int) -> Column:
    return words_up_to(text, n) < n


def lines(text: Column) -> Column:
    """Pieces between line breaks; a trailing break still leaves a final empty piece."""
    return F.split(F.coalesce(text, F.lit("")), fv.LINE_BREAK)


def _has_odd_break(text: Column) -> Column:
    """Is there a line break other than a newline? Plain searches, no pattern."""
    return any_of([F.contains(text, F.lit(c)) for c in fv.LINE_BREAK_CHARS if c != "\n"])


def line_count(text: Column) -> Column:
    """Number of lines; the text after a trailing break is not a line."""
    text = F.coalesce(text, F.lit(""))
    no_last = (text == "") | F.right(text, F.lit(1)).isin(*fv.LINE_BREAK_CHARS)
    # Splitting at a single character needs no pattern.
    pieces = F.when(_has_odd_break(text), F.size(F.split(text, fv.LINE_BREAK))).otherwise(
        F.size(F.split(text, "\n"))
    )
    return pieces - no_last.cast("int")


def subject(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def body(message: Column) -> Column:
    """Everything after the first newline, later newlines included; ``''`` without one."""
    return F.coalesce(F.get(F.split(message, "\n", 2), 1), F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_ext(path: Column) -> Column:
    """Extension with its dot; leading dots of the base name do not start one."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)\z", 1)


def language(path: Column) -> Column:
    """Language by lower-cased extension, null when unknown."""
    table = F.create_map(*[F.lit(x) for pair in fv.LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(table, F.lower(file_ext(path)))


def strip_trailers(text: Column) -> Column:
    """Drop trailer lines and the blank lines directly after them, then strip.

    Line breaks are first made uniform, then one multi-line pattern takes a trailer line together
    with its blank followers. The blank-line loop is possessive, so it cannot overflow the stack.
    Most texts have neither odd breaks nor trailers; plain searches spare them the patterns.
    """
    blank = f"[{fv.WS}&&[^\n]]*+"
    trailers = "|".join(p.replace("(", r"\(") for p in fv.TRAILER_PREFIXES)
    trailer_block = f"(?m)^{blank}(?:{trailers})[^\n]*+(?:\n{blank}(?=\n|\\z))*+\n?"
    text = F.coalesce(text, F.lit(""))
    odd, named = _has_odd_break(text), _has_trailer_prefix(text)
    uniform = F.when(odd, F.regexp_replace(text, fv.LINE_BREAK, "\n")).otherwise(text)
    return strip(F.when(named, F.regexp_replace(uniform, trailer_block, "")).otherwise(uniform))


def _has_trailer_prefix(text: Column) -> Column:
    """Does any prefix occur anywhere? Texts without a colon are not searched for those that have one."""
    with_colon = [F.contains(text, F.lit(p)) for p in fv.TRAILER_PREFIXES if ":" in p]
    others = [F.contains(text, F.lit(p)) for p in fv.TRAILER_PREFIXES if ":" not in p]
    return (F.contains(text, F.lit(":")) & any_of(with_colon)) | any_of(others)


def strip_html_comments(text: Column) -> Column:
    """Remove terminated HTML comments and strip; null becomes ``''``."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", ""))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text of an instant in UTC; microseconds only when there are any."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    with_micros = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    has_micros = F.unix_micros(utc) % 1000000 != 0
    return F.concat(F.when(has_micros, with_micros).otherwise(whole), F.lit("+00:00"))


def or_default(value: Column, default: str) -> Column:
    """``default`` for null and for empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
