"""Stage 3: how well a commit's subject describes its change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.functions import fixed_values as fv
from histloom.functions import text as tx
from histloom.operators.rules import Rule
from histloom.params import FilterParams

_WORD = f"[{fv.ALNUM}_]"
_SCOPED_TYPE = rf"^{_WORD}+\([^)]*\):[{fv.WS}]*"
_SCOPE = rf"^[{fv.ALNUM}_/.-]+:[{fv.WS}]+"
# No verb of the list ends in s, so an optional third-person ending needs no case for "ss".
_VERB = rf"^(?:{'|'.join(fv.IMPERATIVE_VERBS)})(?:es|s)?\z"
_GENERIC = rf"(?:^| )(?:{'|'.join(' '.join(p) for p in fv.GENERIC_PHRASES)})(?: |\z)"


def verb_start_score(subject: Column) -> Column:
    """1.0 when the first word after a type or scope prefix is an imperative verb."""
    untyped = F.regexp_replace(tx.strip(subject), _SCOPED_TYPE, "")
    unscoped = F.regexp_replace(untyped, _SCOPE, "")
    first = F.regexp_extract(unscoped, f"^[^{fv.WS}]+", 0)
    letters = F.lower(F.regexp_replace(first, "[^a-zA-Z]", ""))
    return F.when(letters.rlike(_VERB), F.lit(1.0)).otherwise(F.lit(0.0))


def informativeness_score(subject: Column, files: Column) -> Column:
    subj = tx.strip(subject)
    plain = F.filter(tx.words(subj), lambda w: w.rlike(rf"^[{fv.ALNUM}]+\z"))
    phrase = F.lower(F.array_join(plain, " "))
    lowered = F.lower(subj)
    named = F.exists(
        files,
        lambda f: (F.lower(f["filename"]) == lowered)
        | (F.lower(tx.basename(f["filename"])) == lowered),
    )
    return (
        F.when(F.size(plain) < 3, F.lit(0.2))
        .when(phrase.rlike(_GENERIC), F.lit(0.3))
        .when(named, F.lit(0.1))
        .otherwise(F.lit(1.0))
    )


def searchable_tokens(subject: Column) -> Column:
    """Distinct lower-cased tokens longer than three characters that are not stop words."""
    long_ones = F.filter(tx.words(subject), lambda w: F.length(w) > 3)
    lowered = F.array_distinct(F.transform(long_ones, F.lower))
    return F.filter(lowered, lambda w: ~w.isin(*fv.STOP_WORDS))


def haystack(files: Column) -> Column:
    pieces = F.transform(files, lambda f: F.concat(F.lit(" "), f["filename"], F.lit(" "), f["diff"]))
    return F.lower(F.array_join(pieces, ""))


def alignment_score(subject: Column, files: Column) -> Column:
    """Share of the searchable tokens found in the changed paths and diffs; 1.0 without tokens."""

    def share(tokens: Column) -> Column:
        cleaned = F.transform(tokens, lambda t: F.regexp_replace(t, rf"[^{fv.ALNUM}_]+", ""))
        hits = tx.let(
            haystack(files),
            lambda hay: F.size(F.filter(cleaned, lambda t: (t != "") & F.contains(hay, t))),
        )
        return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(
            hits.cast("double") / F.size(tokens)
        )

    return tx.let(searchable_tokens(subject), share)


def language_bonus(n_code_files: Column) -> Column:
    return F.when(n_code_files > 0, F.lit(1.0)).otherwise(F.lit(0.5))


def weighted(verb: Column, informative: Column, aligned: Column, lang: Column) -> Column:
    w = fv.SCORE_WEIGHTS
    return (
        F.lit(w["verb"]) * verb
        + F.lit(w["informative"]) * informative
        + F.lit(w["aligned"]) * aligned
        + F.lit(w["language"]) * lang
    )


def with_scores(commits: DataFrame) -> DataFrame:
    """Adds verb_score, info_score, align_score, lang_score and their weighted ``score``."""
    subject = F.col("message_subject")
    parts = commits.withColumns(
        {
            "verb_score": verb_start_score(subject),
            "info_score": informativeness_score(subject, F.col("files")),
            "align_score": alignment_score(subject, F.col("files")),
            "lang_score": language_bonus(F.col("n_code_files")),
        }
    )
    score = weighted(*[F.col(c) for c in ("verb_score", "info_score", "align_score", "lang_score")])
    return parts.withColumn("score", score)


def quality_rules(p: FilterParams) -> list[Rule]:
    rules = [
        ("alignment_below_threshold", F.col("align_score") < p.min_alignment_score),
        ("no_verb_start", F.lit(p.require_verb_start) & (F.col("verb_score") < 1.0)),
        ("score_below_threshold", F.col("score") < p.min_content_score),
    ]
    return [(f"content_quality:{name}", fails) for name, fails in rules]
