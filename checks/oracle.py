"""SQL with the same results for every registered query, for a second engine (DuckDB).

Written independently of the library where that is possible: rows instead of arrays, window
functions instead of patterns, numbering and recursion instead of rounds and counting.
"""

from __future__ import annotations

from checks.queries import BRANCHES, EXCLUSIONS, SINCE
from checks.tables import duckdb_views, referenced
from histloom import params as pm
from histloom.functions import fixed_values as fv
from histloom.functions import minhash as mh
from histloom.operators import report

P = pm.profile("default").filter


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def re2(pattern: str) -> str:
    """Java pattern as RE2: its dot and case folding need no d and u flags."""
    return q(pattern.replace("(?iu)", "(?i)").replace("(?iud)", "(?i)"))


def strip(expr: str) -> str:
    return f"trim({expr}, {q(fv.WHITESPACE_CHARS)})"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(f'[{fv.WS}]+')}), lambda w: w <> '')"


def n_words(expr: str) -> str:
    return f"coalesce(len({tokens(expr)}), 0)"


def n_lines(expr: str) -> str:
    pieces = f"regexp_split_to_array({expr}, {q(fv.LINE_BREAK)})"
    return f"(CASE WHEN coalesce({expr}, '') = '' THEN 0 ELSE len({pieces}) - CASE WHEN {pieces}[-1] = '' THEN 1 ELSE 0 END END)"


def ext(expr: str) -> str:
    return rf"regexp_extract({expr}, '[^/.][^/]*(\.[^./]*)\z', 1)"


def base(expr: str) -> str:
    return f"split_part({expr}, '/', -1)"


def uncomment(expr: str) -> str:
    return strip(f"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')")


def iso(expr: str) -> str:
    return f"coalesce(strftime({expr}, '%Y-%m-%dT%H:%M:%S') || '+00:00', '')"


def first_reason(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {q(name)}" for name, cond in rules) + " END"


SUBJ = strip("message_subject")
EXCL = {
    "is_merge": "is_merge OR n_parents > 1 OR starts_with(lower(message_subject), 'merge ')",
    "is_revert": f"regexp_matches({SUBJ}, {re2(fv.REVERT_SUBJECT)})",
    "is_bot": f"regexp_matches(lower(concat(author, ' ', author_email)), {re2(fv.BOT_AUTHOR)})",
    "no_files": "n_files = 0",
    "binary_only": "n_files > 0 AND n_text_files = 0",
    "lockfile_only": "n_files > 0 AND n_generated_files = n_files",
    "empty_or_trivial_message": f"lower({SUBJ}) IN {among(('', *fv.TRIVIAL_SUBJECTS))}",
    "wip_message": f"regexp_matches({SUBJ}, {re2(fv.WIP_SUBJECT)})",
    "version_bump_only": f"regexp_matches({SUBJ}, {re2(fv.VERSION_SUBJECT)}) AND n_version_files = n_files",
    "url_only_message": f"regexp_matches({SUBJ}, {re2(fv.URL_SUBJECT)})",
    "ticket_only_message": f"regexp_matches({SUBJ}, {re2(fv.TICKET_SUBJECT)})",
}


def exclusion(p: pm.FilterParams) -> list[tuple[str, str]]:
    on = {
        "is_merge": p.exclude_merge_commits,
        "is_revert": p.exclude_revert_commits,
        "is_bot": p.exclude_bot_authors,
        "no_files": p.exclude_binary_only,
        "binary_only": p.exclude_binary_only,
        "wip_message": p.exclude_wip_messages,
    }
    return [(f"hard_exclusion:{n}", c) for n, c in EXCL.items() if on.get(n, True)]


def structure(p: pm.FilterParams) -> list[tuple[str, str]]:
    return [
        ("structural:message_too_short", f"{n_words('full_message')} < {p.min_commit_message_words}"),
        ("structural:message_too_long", f"length(full_message) > {p.max_commit_message_chars}"),
        ("structural:too_few_files", f"n_files < {p.min_files_changed}"),
        ("structural:too_many_files", f"n_files > {p.max_files_changed}"),
        ("structural:diff_too_small", f"diff_lines < {p.min_diff_lines}"),
        ("structural:diff_too_large", f"diff_lines > {p.max_diff_lines}"),
    ]


def quality(p: pm.FilterParams) -> list[tuple[str, str]]:
    rules = [
        (
            "content_quality:alignment_below_threshold",
            f"align_score < cast({p.min_alignment_score} AS double)",
        )
    ]
    if p.require_verb_start:
        rules.append(("content_quality:no_verb_start", "verb_score < 1.0"))
    low = f"score < cast({p.min_content_score} AS double)"
    return [*rules, ("content_quality:score_below_threshold", low)]


def pull_structure(p: pm.FilterParams) -> list[tuple[str, str]]:
    n = n_lines("diff")
    return [
        ("structural:pr_body_too_short", f"{n_words('body')} < {p.min_pr_body_words}"),
        ("structural:pr_diff_too_small", f"diff <> '' AND {n} < {p.min_diff_lines}"),
        ("structural:pr_diff_too_large", f"diff <> '' AND {n} > {p.max_diff_lines}"),
        ("structural:pr_diff_missing", "diff = ''"),
    ]


def patch_gates(p: pm.FilterParams) -> tuple[str, str]:
    unlinked = "n_links = 0" if p.require_linked_issue else "false"
    thin = f"{n_words('context')} < {p.min_issue_to_patch_words}"
    stage = f"CASE WHEN {unlinked} THEN 'stage1' WHEN {thin} THEN 'stage3' END"
    reason = first_reason(
        [("pr_exclusion:no_linked_issue", unlinked), ("content_quality:insufficient_context", thin)]
    )
    return stage, reason


def weighted(v: str, i: str, a: str, n: str) -> str:
    w = [f"cast({x} AS double)" for x in fv.SCORE_WEIGHTS.values()]
    return f"{w[0]} * {v} + {w[1]} * {i} + {w[2]} * {a} + {w[3]} * {n}"


def signature_sql(source: str, key: str, text: str) -> str:
    """Signature list per row of ``source``: the permuted minima over its distinct tokens."""
    a, b = mh.COEFFICIENTS
    minima = ", ".join(
        f"min(((h * {a[i]} + {b[i]}) % 18446744073709551616 % {mh.PRIME}) % {mh.MAX_HASH + 1})"
        for i in range(mh.NUM_PERM)
    )
    return f"""
        SELECT {key}, [{minima}] AS signature FROM (
            SELECT {key}, cast(concat('0x', d[7:8], d[5:6], d[3:4], d[1:2]) AS bigint)::hugeint AS h
            FROM (SELECT {key}, sha1(t) AS d FROM (
                SELECT DISTINCT {key}, unnest({tokens(text)}) AS t FROM {source})))
        GROUP BY {key}"""


def bands_sql(source: str, key: str, threshold: float) -> str:
    bands, rows = mh.band_shape(threshold)
    return f"""
        SELECT {key}, i AS band,
            md5(concat(i, ',', array_to_string(signature[i * {rows} + 1:(i + 1) * {rows}], ','))) AS band_key
        FROM {source}, LATERAL (SELECT unnest(range(0, {bands})) AS i)"""


def keep_first_sql(records: str, bands: str, name: str) -> list[tuple[str, str]]:
    """One record after the other: ``records`` (pos 1.., digest), ``bands`` (pos, band_key)."""
    return [
        (
            f"{name}_rows",
            f"""SELECT r.pos, r.digest, coalesce(b.keys, cast([] AS ubigint[])) AS keys,
                row_number() OVER (PARTITION BY r.digest ORDER BY r.pos) > 1 AS copy
            FROM {records} r LEFT JOIN (SELECT pos, list(hash(band_key)) AS keys FROM {bands} GROUP BY pos) b
                ON r.pos = b.pos""",
        ),
        (
            f"{name}_walk",
            f"""SELECT cast(0 AS bigint) AS pos, cast([] AS ubigint[]) AS seen, false AS is_duplicate
            UNION ALL
            SELECT r.pos,
                CASE WHEN r.copy OR list_has_any(w.seen, r.keys) THEN w.seen
                    ELSE list_concat(w.seen, r.keys) END,
                r.copy OR list_has_any(w.seen, r.keys)
            FROM {name}_walk w JOIN {name}_rows r ON r.pos = w.pos + 1""",
        ),
    ]


DIFF_PART = "concat('diff --git a/', filename, ' b/', filename, chr(10), diff)"
GENERATED = " OR ".join(f"contains(lower(filename), {q(x)})" for x in fv.GENERATED_PATH_PARTS)
LANGS = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.LANGUAGE_BY_EXTENSION.items())
TRAILER = " OR ".join(f"starts_with(s, {q(x)})" for x in fv.TRAILER_PREFIXES)
VERB_BASE = "regexp_replace(first_word, '(?i)[^a-z]', '', 'g')"
GENERIC = " OR ".join(f"(a = {q(x)} AND b = {q(y)})" for x, y in fv.GENERIC_PHRASES)


def _ctes() -> list[tuple[str, str]]:
    word = f"[{fv.ALNUM}_]"
    ctes = list(duckdb_views().items())
    ctes += [
        (
            "commits",
            """SELECT repo, sha, doc_id, split_part(message, chr(10), 1) AS message_subject,
                CASE WHEN contains(message, chr(10))
                    THEN message[position(chr(10) IN message) + 1:] ELSE '' END AS message_body,
                author, coalesce(author_email, '') AS author_email, author_ts, is_merge,
                CASE WHEN doc_id % 37 = 0 THEN 2 ELSE 1 END AS n_parents
            FROM fx_commits""",
        ),
        (
            "files",
            f"""SELECT *, CASE lower({ext("filename")}) {LANGS} END AS language FROM (
                SELECT repo, sha, pos, coalesce(nullif(new_path, ''), old_path, '') AS filename,
                CASE WHEN change_type IN ('ADD', 'DELETE', 'RENAME') THEN change_type
                    ELSE 'MODIFY' END AS change_type,
                coalesce(diff, '') AS diff, additions, deletions FROM fx_files)""",
        ),
        (
            "facts",
            f"""SELECT repo, sha, count(*) AS n_files,
                count(*) FILTER (lower({ext("filename")}) IN {among(fv.TEXT_EXTENSIONS)}) AS n_text_files,
                count(*) FILTER ({GENERATED}) AS n_generated_files,
                count(*) FILTER (lower({base("filename")}) IN {among(fv.VERSION_FILES)}) AS n_version_files,
                count(*) FILTER (language IS NOT NULL AND language NOT IN {among(fv.NON_CODE_LANGUAGES)}) AS n_code_files,
                cast(sum({n_lines("diff")}) AS bigint) AS diff_lines,
                cast(sum(additions) AS bigint) AS total_additions,
                cast(sum(deletions) AS bigint) AS total_deletions,
                string_agg({DIFF_PART}, chr(10) ORDER BY pos) AS diff_text,
                lower(string_agg(concat(' ', filename, ' ', diff), '' ORDER BY pos)) AS hay,
                list(lower(filename)) AS names, list(lower({base("filename")})) AS bases
            FROM files GROUP BY repo, sha""",
        ),
        (
            "body_lines",
            f"""SELECT sha, i, line, s, ({TRAILER}) AS is_trailer FROM (
                SELECT *, {strip("line")} AS s FROM (
                    SELECT sha, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS i FROM (
                        SELECT sha, regexp_split_to_array(message_body, {q(fv.LINE_BREAK)}) AS pieces
                        FROM commits)))""",
        ),
        (
            "clean_bodies",
            f"""SELECT sha, {strip("string_agg(line, chr(10) ORDER BY i)")} AS clean_body FROM (
                SELECT *, last_value(CASE WHEN s <> '' THEN is_trailer END IGNORE NULLS) OVER (
                    PARTITION BY sha ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_trailer
                FROM body_lines)
            WHERE NOT is_trailer AND NOT (s = '' AND coalesce(after_trailer, false)) GROUP BY sha""",
        ),
        (
            "described",
            f"""SELECT c.*, {", ".join(
                f"coalesce({n}, 0) AS {n}" for n in (
                    "n_files", "n_text_files", "n_generated_files", "n_version_files",
                    "n_code_files", "diff_lines", "total_additions", "total_deletions"))},
                coalesce(diff_text, '') AS diff_text, coalesce(hay, '') AS hay,
                coalesce(names, []) AS names, coalesce(bases, []) AS bases,
                coalesce(clean_body, '') AS clean_body,
                {strip("concat(message_subject, chr(10), coalesce(clean_body, ''))")} AS full_message
            FROM commits c LEFT JOIN facts USING (repo, sha) LEFT JOIN clean_bodies USING (sha)""",
        ),
        (
            "unscoped",
            f"""SELECT sha, regexp_extract(regexp_replace(regexp_replace({SUBJ},
                {q(rf"^{word}+\([^)]*\):[{fv.WS}]*")}, ''), {q(rf"^[{fv.ALNUM}_/.-]+:[{fv.WS}]+")}, ''),
                {q(f"^[^{fv.WS}]+")}) AS first_word FROM commits""",
        ),
        (
            "verbs",
            f"""SELECT sha, CASE WHEN v IN {among(fv.IMPERATIVE_VERBS)}
                OR (v LIKE '%es' AND v[:-3] IN {among(fv.IMPERATIVE_VERBS)})
                OR (v LIKE '%s' AND v NOT LIKE '%ss' AND v[:-2] IN {among(fv.IMPERATIVE_VERBS)})
                THEN 1.0::double ELSE 0.0::double END AS verb_score
            FROM (SELECT sha, lower({VERB_BASE}) AS v FROM unscoped)""",
        ),
        (
            "plain_words",
            f"""SELECT sha, lower(w) AS w, row_number() OVER (PARTITION BY sha ORDER BY i) AS i FROM (
                SELECT sha, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
                    SELECT sha, {tokens(SUBJ)} AS ws FROM commits))
            WHERE regexp_matches(w, {q(rf"^[{fv.ALNUM}]+\z")})""",
        ),
        (
            "phrases",
            f"""SELECT sha, count(*) AS n_plain, bool_or({GENERIC}) AS generic FROM (
                SELECT sha, w AS a, lead(w) OVER (PARTITION BY sha ORDER BY i) AS b FROM plain_words)
            GROUP BY sha""",
        ),
        (
            "informative",
            f"""SELECT sha, CASE WHEN coalesce(n_plain, 0) < 3 THEN 0.2::double WHEN generic THEN 0.3::double
                WHEN list_contains(names, lower({SUBJ})) OR list_contains(bases, lower({SUBJ})) THEN 0.1::double
                ELSE 1.0::double END AS info_score
            FROM described LEFT JOIN phrases USING (sha)""",
        ),
        (
            "aligned",
            f"""SELECT sha, coalesce(hits / n, 1.0::double) AS align_score FROM described LEFT JOIN (
                SELECT sha, count(*)::double AS n,
                    count(*) FILTER (c <> '' AND contains(hay, c))::double AS hits FROM (
                    SELECT DISTINCT sha, hay, t, regexp_replace(t, {q(rf"[^{fv.ALNUM}_]+")}, '', 'g') AS c FROM (
                        SELECT sha, hay, lower(w) AS t, length(w) AS n FROM (
                            SELECT sha, hay, unnest({tokens("message_subject")}) AS w FROM described))
                    WHERE n > 3 AND t NOT IN {among(fv.STOP_WORDS)})
                GROUP BY sha) USING (sha)""",
        ),
        (
            "scored",
            f"""SELECT *, {weighted("verb_score", "info_score", "align_score", "lang_score")} AS score FROM (
                SELECT d.*, verb_score, info_score, align_score,
                    CASE WHEN n_code_files > 0 THEN 1.0::double ELSE 0.5::double END AS lang_score,
                    CASE WHEN n_files > 0 THEN concat(diff_text, chr(10)) ELSE '' END AS terminated
                FROM described d JOIN verbs USING (sha) JOIN informative USING (sha) JOIN aligned USING (sha))""",
        ),
        (
            "pulls",
            """SELECT repo, number, title, body, coalesce(diff, '') AS diff, updated_at, merged_at,
                coalesce(links, []) AS links, len(coalesce(links, [])) AS n_links
            FROM fx_pulls LEFT JOIN (
                SELECT repo, number, list(d ORDER BY length(d), d) AS links FROM (
                    SELECT DISTINCT repo, number, regexp_replace(x, '^0+([0-9])', '\\1') AS d FROM (
                        SELECT repo, number, unnest(list_concat(
                            regexp_extract_all(body, '#([0-9]+)', 1),
                            regexp_extract_all(body, '(?:issues|pulls)/([0-9]+)', 1))) AS x
                        FROM fx_pulls))
                WHERE d <> cast(number AS varchar) GROUP BY repo, number) USING (repo, number)""",
        ),
        (
            "links",
            """SELECT repo, number, issue, CASE WHEN open_issues IS NULL THEN 100000
                ELSE greatest(open_issues * 3, 5000) END AS ceiling
            FROM (SELECT repo, number, unnest(links) AS issue FROM pulls)
            LEFT JOIN fx_repo_sizes ON full_name = repo""",
        ),
        (
            "resolved",
            """SELECT l.repo, l.number, list(concat('Issue #', issue, ':', chr(10), i.body)
                ORDER BY length(issue), issue) AS blocks
            FROM links l JOIN fx_issues i ON i.repo = l.repo AND cast(i.number AS varchar) = issue
            WHERE cast(issue AS hugeint) <= ceiling AND coalesce(i.body, '') <> ''
            GROUP BY l.repo, l.number""",
        ),
        (
            "contexts",
            f"""SELECT *, CASE WHEN parts = '' THEN title ELSE parts END AS context FROM (
                SELECT p.*, coalesce(blocks, []) AS blocks, array_to_string(list_filter(list_concat(
                    list_transform(coalesce(blocks, []), lambda b: {uncomment("b")}),
                    [CASE WHEN {uncomment("body")} = '' THEN ''
                        ELSE concat('PR Description:', chr(10), {uncomment("body")}) END]),
                    lambda x: x <> ''), concat(chr(10), chr(10))) AS parts
                FROM pulls p LEFT JOIN resolved USING (repo, number))""",
        ),
        (
            "comments",
            """SELECT repo, number, count(*) AS n_comments,
                string_agg(concat('[', path, '] ', body), chr(10) ORDER BY pos) AS comment_lines,
                string_agg(concat('### Review Comment on `', path, '`:', chr(10), '**Context:**', chr(10),
                    '```diff', chr(10), diff_hunk, chr(10), '```', chr(10), '**Feedback:** ', body),
                    concat(chr(10), chr(10)) ORDER BY pos) AS comment_blocks,
                string_agg(concat(path, '|', diff_hunk, '|', body, '|', coalesce(author, 'unknown')),
                    chr(10) ORDER BY pos) AS comment_rows
            FROM fx_comments GROUP BY repo, number""",
        ),
        ("doc_signatures", signature_sql("documents", "doc_id", "text")),
        ("doc_bands", bands_sql("doc_signatures", "doc_id", P.dedup_threshold)),
        ("doc_records", "SELECT doc_id + 1 AS pos, sha256(text) AS digest FROM documents"),
        ("doc_keys", "SELECT doc_id + 1 AS pos, concat(band, '-', band_key) AS band_key FROM doc_bands"),
        *keep_first_sql("doc_records", "doc_keys", "doc"),
        ("doc_tokens", f"SELECT DISTINCT doc_id, unnest({tokens('text')}) AS t FROM documents"),
        ("doc_sizes", "SELECT doc_id, count(*) AS n FROM doc_tokens GROUP BY doc_id"),
        (
            "doc_kept",
            """SELECT t.* FROM doc_tokens t JOIN doc_walk ON pos = doc_id + 1 WHERE NOT is_duplicate""",
        ),
        (
            "doc_similar",
            f"""SELECT doc_id, min(other) AS witness_id, arg_min(jaccard, other) AS jaccard FROM (
                SELECT a.doc_id, b.doc_id AS other,
                    count(*)::double / (any_value(x.n) + any_value(y.n) - count(*))::double AS jaccard
                FROM doc_tokens a JOIN doc_kept b ON a.t = b.t AND b.doc_id < a.doc_id
                JOIN doc_sizes x ON x.doc_id = a.doc_id JOIN doc_sizes y ON y.doc_id = b.doc_id
                WHERE least(x.n, y.n) >= {P.dedup_threshold - 0.001} * greatest(x.n, y.n)
                GROUP BY a.doc_id, b.doc_id)
            WHERE jaccard >= {P.dedup_threshold}::double GROUP BY doc_id""",
        ),
        (
            "doc_evidence",
            """SELECT pos - 1 AS doc_id, is_duplicate, witness_id, jaccard
            FROM doc_walk LEFT JOIN doc_similar ON doc_id = pos - 1 WHERE pos > 0""",
        ),
        # Every commit and merged pull request under one index, without other rules.
        (
            "any_records",
            """SELECT *, row_number() OVER (ORDER BY repo, source_rank, place) AS pos FROM (
                SELECT repo, 'commit' AS source, 0 AS source_rank, sha AS record_id,
                    row_number() OVER (PARTITION BY repo ORDER BY author_ts DESC, sha) AS place,
                    concat(message_subject, chr(10), terminated) AS content FROM scored
                UNION ALL
                SELECT repo, 'pr', 1, cast(number AS varchar),
                    row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, number DESC),
                    concat(title, chr(10), diff) FROM pulls WHERE merged_at IS NOT NULL)""",
        ),
        ("any_digests", "SELECT pos, sha256(content) AS digest FROM any_records"),
        ("any_signatures", signature_sql("any_records", "pos", "content")),
        ("any_bands", bands_sql("any_signatures", "pos", P.dedup_threshold)),
        ("any_keys", "SELECT pos, concat(band, '-', band_key) AS band_key FROM any_bands"),
        *keep_first_sql("any_digests", "any_keys", "any"),
        # The whole run with the default preset.
        (
            "commit_verdicts",
            f"""SELECT *, {first_reason(exclusion(P))} AS r1, {first_reason(structure(P))} AS r2,
                {first_reason(quality(P))} AS r3 FROM scored""",
        ),
        ("pull_verdicts", f"SELECT *, {first_reason(pull_structure(P))} AS r2 FROM contexts WHERE merged_at IS NOT NULL"),
    ]
    for task, commits_in, pulls_in in (("cm", True, False), ("pr", False, True), ("all", True, True)):
        ctes += _run_ctes(f"run_{task}", commits_in, pulls_in)
    for name in pm.profile_names():
        ctes += _selected_ctes(name, pm.profile(name))
        ctes += _run_ctes(
            f"run_{name}", True, True, pm.profile(name).filter, f"{name}_commits", f"{name}_pulls"
        )
    return ctes


def _selected_ctes(name: str, p: pm.RunParams) -> list[tuple[str, str]]:
    """Verdicts of stages 1 to 3 on what a preset selects."""
    f, c = p.filter, p.collect
    day = f"TIMESTAMP '{c.since.isoformat()} 00:00:00'" if c.since else "TIMESTAMP '0001-01-01 00:00:00'"
    return [
        (
            f"{name}_commits",
            f"""SELECT *, {first_reason(exclusion(f))} AS r1, {first_reason(structure(f))} AS r2,
                {first_reason(quality(f))} AS r3 FROM (SELECT *, row_number() OVER (
                    PARTITION BY repo ORDER BY author_ts DESC, sha) AS rank FROM scored WHERE author_ts >= {day})
            WHERE rank <= {c.max_commits_per_repo}""",
        ),
        (
            f"{name}_pulls",
            f"""SELECT *, {first_reason(pull_structure(f))} AS r2 FROM (SELECT *, row_number() OVER (
                    PARTITION BY repo ORDER BY place) AS rank FROM (SELECT *, row_number() OVER (
                        PARTITION BY repo ORDER BY updated_at DESC, number DESC) AS place FROM contexts)
                WHERE place <= {5 * c.max_prs_per_repo} AND merged_at >= {day})
            WHERE rank <= {c.max_prs_per_repo}""",
        ),
    ]


def _run_ctes(
    n: str, commits_in: bool, pulls_in: bool, p: pm.FilterParams = P,
    commits: str = "commit_verdicts", pulls: str = "pull_verdicts",
) -> list[tuple[str, str]]:
    """Stage 4 among the records that a run brings there."""
    parts = []
    if commits_in:
        parts.append(
            f"""SELECT repo, 'commit' AS source, 0 AS source_rank, sha AS record_id, -epoch(author_ts) AS place,
            sha AS tie, concat(message_subject, chr(10), terminated) AS content
            FROM {commits} WHERE r1 IS NULL AND r2 IS NULL AND r3 IS NULL"""
        )
    if pulls_in:
        parts.append(
            f"""SELECT repo, 'pr' AS source, 1 AS source_rank, cast(number AS varchar) AS record_id,
            -epoch(updated_at) AS place, '' AS tie, concat(title, chr(10), diff) AS content
            FROM {pulls} WHERE r2 IS NULL"""
        )
    stage, reason = patch_gates(p)
    banded = "" if p.dedup_method == "minhash" else " WHERE false"
    ctes = [
        (
            f"{n}_records",
            "SELECT *, row_number() OVER (ORDER BY repo, source_rank, place, tie) AS pos FROM ("
            + " UNION ALL ".join(parts)
            + ")",
        ),
        (f"{n}_digests", f"SELECT pos, sha256(content) AS digest FROM {n}_records"),
        (f"{n}_signatures", signature_sql(f"{n}_records", "pos", "content")),
        (f"{n}_bands", bands_sql(f"{n}_signatures", "pos", p.dedup_threshold)),
        (f"{n}_keys", f"SELECT pos, concat(band, '-', band_key) AS band_key FROM {n}_bands{banded}"),
        *keep_first_sql(f"{n}_digests", f"{n}_keys", n),
        (
            f"{n}_dups",
            f"SELECT repo, source, record_id FROM {n}_records JOIN {n}_walk USING (pos) WHERE is_duplicate",
        ),
        (
            f"{n}_pulls",
            f"""SELECT p.*, record_id IS NOT NULL AS is_duplicate, {stage} AS gate_stage, {reason} AS gate_reason
            FROM {pulls} p LEFT JOIN {n}_dups d
                ON d.source = 'pr' AND d.repo = p.repo AND d.record_id = cast(p.number AS varchar)""",
        ),
        (
            f"{n}_commits",
            f"""SELECT c.*, record_id IS NOT NULL AS is_duplicate
            FROM {commits} c LEFT JOIN {n}_dups d
                ON d.source = 'commit' AND d.repo = c.repo AND d.record_id = c.sha""",
        ),
    ]
    return ctes


def decisions(n: str) -> str:
    """One row per decision of a run."""
    commits = f"""
    SELECT repo, 'commit' AS source, sha AS record_id,
        CASE WHEN r1 IS NULL AND r2 IS NULL THEN 'commit_message' END AS task,
        CASE WHEN r1 IS NOT NULL THEN 'stage1' WHEN r2 IS NOT NULL THEN 'stage2'
            WHEN r3 IS NOT NULL THEN 'stage3' WHEN is_duplicate THEN 'stage4' END AS stage_failed,
        coalesce(r1, r2, r3, CASE WHEN is_duplicate THEN 'dedup:near_duplicate' END) AS reason,
        CASE WHEN r1 IS NULL AND r2 IS NULL THEN score END AS score,
        message_subject AS headline
    FROM {n}_commits"""
    pulls = f"""
    SELECT repo, 'pr', cast(number AS varchar), NULL,
        CASE WHEN r2 IS NOT NULL THEN 'stage2' ELSE 'stage4' END,
        coalesce(r2, 'dedup:near_duplicate_pr'), NULL, title
    FROM {n}_pulls WHERE r2 IS NOT NULL OR is_duplicate
    UNION ALL
    SELECT repo, 'pr', cast(number AS varchar), 'pr_review', NULL, NULL, 1.0::double, title
    FROM {n}_pulls WHERE r2 IS NULL AND NOT is_duplicate
    UNION ALL
    SELECT repo, 'pr', cast(number AS varchar), 'issue_to_patch', gate_stage, gate_reason, 1.0::double, title
    FROM {n}_pulls WHERE r2 IS NULL AND NOT is_duplicate"""
    return f"({commits} UNION ALL {pulls})"


DECISIONS = decisions("run_all")
PASSED_COMMIT = "r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND NOT is_duplicate"
PASSED_PULL = "r2 IS NULL AND NOT is_duplicate"


def meta(task: str, when: str, score: str, sha: str = "NULL", number: str = "NULL") -> str:
    return f"""repo AS meta_repo, cast({sha} AS varchar) AS meta_sha, cast({number} AS bigint) AS meta_pr_number,
        {q(task)} AS meta_task, cast({score} AS double) AS meta_score, {iso(when)} AS meta_timestamp"""


def commit_alpaca(source: str) -> str:
    return f"""SELECT {q(fv.COMMIT_INSTRUCTION)} AS instruction, diff_text AS input, message_subject AS output,
        {meta("commit_message", "author_ts", "score", sha="sha")} FROM {source}"""


def review_alpaca(source: str) -> str:
    return f"""SELECT {q(fv.REVIEW_INSTRUCTION)} AS instruction, diff AS input,
        coalesce(comment_lines, '') AS output, {meta("pr_review", "merged_at", "NULL", number="number")}
        FROM {source} LEFT JOIN comments USING (repo, number)"""


def review_sharegpt(source: str) -> str:
    return f"""SELECT 'system,human,gpt' AS speakers, {q(fv.REVIEW_CHAT_SYSTEM)} AS system,
        concat('PR #', number, ': ', title, chr(10), chr(10), '**Description:** ',
            CASE WHEN body = '' THEN {q(fv.NO_DESCRIPTION)} ELSE body END, chr(10), chr(10),
            '```diff', chr(10), diff, chr(10), '```') AS human,
        coalesce(comment_blocks, {q(fv.NO_COMMENTS)}) AS gpt,
        {meta("pr_review", "merged_at", "1.0", number="number")}
        FROM {source} LEFT JOIN comments USING (repo, number)"""


def patch_alpaca(source: str) -> str:
    return f"""SELECT {q(fv.PATCH_INSTRUCTION)} AS instruction, context AS input, diff AS output,
        {meta("issue_to_patch", "merged_at", "1.0", number="number")} FROM {source}"""


def _where(source: str, condition: str) -> str:
    return f"(SELECT * FROM {source} WHERE {condition})"


ALL_RECORDS = f"""{commit_alpaca(_where("run_all_commits", PASSED_COMMIT))}
    UNION ALL {review_alpaca(_where("run_all_pulls", PASSED_PULL))}
    UNION ALL {patch_alpaca(_where("run_all_pulls", PASSED_PULL + " AND gate_reason IS NULL"))}"""
BRANCH_POS = f"list_position([{', '.join(q(b) for b in BRANCHES)}], branch) - 1"
FIRST_BRANCH = f"""(SELECT repo, sha, cast(min({BRANCH_POS}) AS int) AS branch_pos, min(author_ts) AS author_ts
    FROM fx_branches WHERE branch IN {among(BRANCHES)} GROUP BY repo, sha)"""
SINCE_SQL = f"TIMESTAMP '{SINCE.isoformat()} 00:00:00'"
SAMPLE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, number DESC) AS rank
    FROM fx_closed) WHERE rank <= 30)"""


def _signal_rows() -> str:
    """(repo, number, rank, login, system_pos, system, doc_url, signal, by_bot), one row per hit."""
    selects = []
    for pos, (name, signals, bots, url) in enumerate(fv.REVIEW_SYSTEMS):
        hit = " ".join(
            f"WHEN contains(t, {q(s.lower())}) OR regexp_matches(t, {q('(?i)' + s)}) THEN {q(s)}"
            for s in signals
        )
        bot = " OR ".join(f"contains(lower(author_login), {q(b)})" for b in bots) or "false"
        selects.append(
            f"""SELECT repo, number, rank, author_login AS login, {pos} AS system_pos, {q(name)} AS system,
            {q(url) if url else "cast(NULL AS varchar)"} AS doc_url, CASE {hit} END AS signal, ({bot}) AS by_bot
            FROM (SELECT *, lower(concat(body, ' ', title, ' ', author_login)) AS t
                FROM {SAMPLE} WHERE merged_at IS NULL)"""
        )
    return f"(SELECT * FROM ({' UNION ALL '.join(selects)}) WHERE signal IS NOT NULL OR by_bot)"


HEALTH = f"""(SELECT *, external_system IS NULL AND merge_rate >= 0.15::double AS is_native,
        CASE WHEN external_system IS NOT NULL AND merge_rate < 0.05::double THEN 'high'
            WHEN merge_rate < 0.10::double THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT repo, merged_count::double / total_sampled::double AS merge_rate, total_sampled, merged_count,
            external_system, system_doc_url, coalesce(bot_usernames, '') AS bot_usernames
        FROM (SELECT repo, count(*) AS total_sampled, count(merged_at) AS merged_count FROM {SAMPLE} GROUP BY repo)
        LEFT JOIN (SELECT repo, first(system ORDER BY rank, system_pos) AS external_system,
                first(doc_url ORDER BY rank, system_pos) AS system_doc_url,
                string_agg(DISTINCT login, ',' ORDER BY login) FILTER (by_bot) AS bot_usernames
            FROM {_signal_rows()} GROUP BY repo) USING (repo)))"""


def _profile_funnel() -> str:
    parts = [
        f"SELECT {q(name)} AS profile, * FROM {decisions(f'run_{name}')}" for name in pm.profile_names()
    ]
    return f"""SELECT profile, source, task, stage_failed, reason, count(*) AS n
        FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL"""


def _limits(n: int) -> str:
    """What limits of ``n`` per repo leave out."""
    counts = "repo, count(*) AS n_seen, least(count(*), {0}) AS n_taken FROM {1} GROUP BY repo"
    looked = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo
        ORDER BY updated_at DESC, number DESC) AS place FROM pulls) WHERE place <= {5 * n} AND merged_at IS NOT NULL)"""
    return f"""SELECT 'max_commits_per_repo' AS "limit", {counts.format(n, "commits")}
        UNION ALL SELECT 'scanned_prs_per_repo', {counts.format(5 * n, "pulls")}
        UNION ALL SELECT 'max_prs_per_repo', {counts.format(n, looked)}"""


def _split(key: str, extra: str) -> str:
    """Sides by position in the order ``key`` of the non-blank lines."""
    return f"""SELECT {extra}, CASE WHEN i <= n - greatest(round_even(n * 0.1, 0), 1) THEN 'train' ELSE 'eval' END AS side
        FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS i, count(*) OVER () AS n
            FROM fx_lines WHERE {strip("value")} <> '')"""


def _selects() -> dict[str, str]:
    gate_strict = patch_gates(pm.profile("strict").filter)
    catalog = """SELECT full_name, CASE WHEN private THEN 'private' ELSE 'public' END AS visibility,
        CASE WHEN coalesce(language, '') = '' THEN 'Unknown' ELSE language END AS language,
        coalesce(stars, 0) AS stars, coalesce(strftime(updated_at, '%Y-%m-%d'), 'Unknown') AS updated_at
        FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY pos) AS i FROM fx_repo_listing)
        WHERE i = 1"""
    selects = {
        "commit_subject_body": "SELECT sha, message_subject, message_body FROM commits",
        "file_change_norm": "SELECT repo, sha, pos, filename, change_type, diff FROM files",
        "language_detect": "SELECT sha, pos, filename, language FROM files",
        "commit_assembly": """SELECT o.repo, o.sha, count(pos) AS n_files,
            coalesce(cast(sum(additions) AS bigint), 0) AS total_additions,
            coalesce(cast(sum(deletions) AS bigint), 0) AS total_deletions, 2 * count(pos) AS diff_lines,
            coalesce(string_agg(new_path, ',' ORDER BY pos), '') AS filenames
            FROM fx_orders o LEFT JOIN fx_order_files f ON o.repo = f.repo AND o.sha = f.sha
            GROUP BY o.repo, o.sha""",
        "file_facts": """SELECT repo, sha, n_files, n_text_files, n_generated_files, n_version_files,
            n_code_files, diff_lines, total_additions, total_deletions FROM described""",
        "commit_branch_dedup": f"SELECT repo, sha, branch_pos FROM {FIRST_BRANCH}",
        "commit_branch_filter": f"""SELECT 'named' AS choice, repo, branch, sha, cast({BRANCH_POS} AS int) AS branch_pos
            FROM fx_branches WHERE branch IN {among(BRANCHES)}
            UNION ALL SELECT 'default', repo, branch, sha, 0 FROM fx_branches WHERE is_default""",
        "commits_newest_n": f"""SELECT * FROM (SELECT repo, sha, cast(row_number() OVER (PARTITION BY repo
            ORDER BY branch_pos, author_ts DESC, sha) AS int) AS arrival FROM {FIRST_BRANCH}) WHERE arrival <= 100""",
        "commits_since": f"SELECT repo, branch, sha FROM fx_branches WHERE author_ts >= {SINCE_SQL}",
        "pr_scan": """SELECT repo, number, cast(arrival AS int) AS arrival FROM (
            SELECT *, row_number() OVER (PARTITION BY repo ORDER BY place) AS arrival FROM (
                SELECT *, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, number DESC) AS place
                FROM fx_closed)
            WHERE place <= 250 AND merged_at >= TIMESTAMP '2024-01-10 00:00:00') WHERE arrival <= 50""",
        "linked_issues": "SELECT repo, number, array_to_string(links, ',') AS linked_issue_numbers FROM pulls",
        "pr_comment_attach": """SELECT repo, number, cast(coalesce(n_comments, 0) AS int) AS n_comments,
            coalesce(comment_rows, '') AS comments FROM pulls LEFT JOIN comments USING (repo, number)""",
        "pr_label_attach": """SELECT p.repo, p.number, coalesce(string_agg(name, ',' ORDER BY pos), '') AS labels
            FROM pulls p LEFT JOIN fx_labels l ON l.repo = p.repo AND l.number = p.number GROUP BY p.repo, p.number""",
        "issue_ceiling": """SELECT repo, number, issue, ceiling, cast(issue AS hugeint) <= ceiling AS reachable
            FROM links""",
        "issue_resolve": "SELECT repo, number, array_to_string(blocks, chr(10)) AS issue_blocks FROM contexts",
        "release_semver": f"SELECT tag_name, regexp_matches(tag_name, {q(fv.SEMVER_TAG)}) AS is_semver FROM fx_releases",
        "release_norm": f"""SELECT tag_name, repo, coalesce(title, '') AS title, coalesce(body, '') AS body,
            regexp_matches(tag_name, {q(fv.SEMVER_TAG)}) AS is_semver,
            {iso("published_at")} AS published_at FROM fx_releases""",
        "repo_catalog": catalog,
        "repo_prefilter": f"SELECT * FROM ({catalog}) WHERE visibility = 'public' AND stars >= 3000",
        "branch_catalog": "SELECT DISTINCT branch FROM fx_branches ORDER BY branch",
        "branch_commit_counts": f"""SELECT r.repo, b.branch, count(f.sha) AS n_commits
            FROM (SELECT DISTINCT repo FROM fx_branches) r
            CROSS JOIN (SELECT unnest([{", ".join(q(b) for b in BRANCHES)}]) AS branch) b
            LEFT JOIN fx_branches f ON f.repo = r.repo AND f.branch = b.branch AND author_ts >= {SINCE_SQL}
            GROUP BY GROUPING SETS ((r.repo, b.branch), (r.repo))""",
        "nonblank_lines": f"SELECT line_no, value FROM fx_lines WHERE {strip('value')} <> ''",
        "word_count": f"SELECT doc_id, {n_words('text')} AS n_words FROM documents",
        "diff_line_count": f"SELECT doc_id, {n_lines('text')} AS n_lines FROM documents",
        "file_ext": f"SELECT sha, pos, {ext('filename')} AS ext, {base('filename')} AS base FROM files",
        "strip_trailers": "SELECT sha, clean_body FROM described",
        "strip_html_comments": f"SELECT page_id, {uncomment('html')} AS clean FROM pages",
        "commit_diff_text": "SELECT repo, sha, diff_text, terminated FROM scored",
        "hard_exclusions": f"SELECT repo, sha, {first_reason(exclusion(P))} AS reason FROM described",
        "structural_commit": f"SELECT repo, sha, {first_reason(structure(P))} AS reason FROM described",
        "structural_pr": f"SELECT repo, number, {first_reason(pull_structure(P))} AS reason FROM pulls",
        "verb_start_score": "SELECT sha, verb_score FROM verbs",
        "informativeness_score": "SELECT sha, info_score FROM informative",
        "alignment_score": "SELECT sha, align_score FROM aligned",
        "language_bonus": "SELECT sha, lang_score FROM scored",
        "content_score": "SELECT sha, score FROM scored",
        "content_quality": f"SELECT repo, sha, score, {first_reason(quality(P))} AS reason FROM scored",
        "patch_gates": f"""SELECT repo, number, {gate_strict[0]} AS stage_failed, {gate_strict[1]} AS reason
            FROM contexts""",
        "dedup_exact": """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
            FROM documents""",
        "minhash_signature": """SELECT doc_id, coalesce(array_to_string(signature, ','), '') AS signature
            FROM documents LEFT JOIN doc_signatures USING (doc_id)""",
        "lsh_bands": "SELECT doc_id, cast(band AS int) AS band, band_key FROM doc_bands",
        "dedup_minhash": "SELECT pos - 1 AS doc_id, is_duplicate FROM doc_walk WHERE pos > 0",
        "near_dup_witness": "SELECT doc_id, is_duplicate, witness_id, jaccard FROM doc_evidence",
        "dedup_recall": """SELECT *, n_similar_dropped::double / n_similar::double AS recall FROM (SELECT
            count(witness_id) AS n_similar,
            count(*) FILTER (witness_id IS NOT NULL AND is_duplicate) AS n_similar_dropped,
            count(*) FILTER (is_duplicate) AS n_dropped,
            count(*) FILTER (is_duplicate AND witness_id IS NULL) AS n_dropped_below FROM doc_evidence)""",
        "dedup_cross_source": """SELECT repo, source, record_id, is_duplicate
            FROM any_records JOIN any_walk USING (pos)""",
        "fmt_commit_alpaca": commit_alpaca("scored"),
        "fmt_commit_sharegpt": f"""SELECT 'system,human,gpt' AS speakers, {q(fv.COMMIT_CHAT_SYSTEM)} AS system,
            concat('Write a commit message for this diff:', chr(10), chr(10), '```diff', chr(10), terminated,
                chr(10), '```') AS human, message_subject AS gpt,
            {meta("commit_message", "author_ts", "score", sha="sha")} FROM scored""",
        "fmt_review_alpaca": review_alpaca("pulls"),
        "fmt_review_sharegpt": review_sharegpt("pulls"),
        "issue_context": "SELECT repo, number, context FROM contexts",
        "fmt_patch_alpaca": patch_alpaca("contexts"),
        "fmt_patch_sharegpt": f"""SELECT 'system,human,gpt' AS speakers, {q(fv.PATCH_INSTRUCTION)} AS system,
            context AS human, diff AS gpt, {meta("issue_to_patch", "merged_at", "1.0", number="number")}
            FROM contexts""",
        "dataset_commit_message": commit_alpaca(_where("run_cm_commits", PASSED_COMMIT)),
        "dataset_pr_review": review_sharegpt(_where("run_pr_pulls", PASSED_PULL)),
        "dataset_issue_to_patch": patch_alpaca(
            _where("run_pr_pulls", PASSED_PULL + " AND gate_reason IS NULL")
        ),
        "dataset_all": ALL_RECORDS,
        "clean_dataset": f"SELECT instruction, input, output FROM ({ALL_RECORDS})",
        "excluded_log": f"""SELECT e.source, e.repo, e.record_id, e.headline, e.stage_failed, e.reason,
            md5(CASE WHEN e.source = 'commit' THEN coalesce(f.content, '')
                ELSE concat(p.diff, chr(10), coalesce(c.comment_rows, '')) END) AS content
            FROM (SELECT * FROM {DECISIONS} WHERE reason IS NOT NULL) e
            LEFT JOIN (SELECT repo, sha, string_agg(concat_ws('|', filename, change_type, additions,
                deletions, diff), chr(10) ORDER BY pos) AS content FROM files GROUP BY repo, sha) f
                ON e.source = 'commit' AND f.repo = e.repo AND f.sha = e.record_id
            LEFT JOIN pulls p
                ON e.source = 'pr' AND p.repo = e.repo AND cast(p.number AS varchar) = e.record_id
            LEFT JOIN comments c ON c.repo = p.repo AND c.number = p.number""",
        "decisions_all": f"SELECT repo, source, record_id, task, stage_failed, reason, score FROM {DECISIONS}",
        "stage_funnel": f"""SELECT stage_failed, count(*) AS n_dropped FROM {DECISIONS}
            WHERE reason IS NOT NULL GROUP BY stage_failed""",
        "reason_counts": f"""SELECT reason, count(*) AS n_dropped FROM {DECISIONS}
            WHERE reason IS NOT NULL GROUP BY reason""",
        "task_distribution": f"""SELECT task, count(*) AS n_records FROM {DECISIONS}
            WHERE reason IS NULL GROUP BY task""",
        "run_stats": f"""SELECT * EXCLUDE total,
            round_even((total - final_records)::double / total::double * 100, 2) AS filter_rate_pct FROM (SELECT
            (SELECT count(*) FROM commits) AS raw_commits_collected,
            (SELECT count(*) FROM pull_verdicts) AS raw_prs_collected,
            (SELECT count(*) FROM (SELECT repo FROM commits UNION SELECT repo FROM pull_verdicts)) AS n_repos,
            count(*) FILTER (stage_failed = 'stage1') AS stage1_hard_exclusion_dropped,
            count(*) FILTER (stage_failed = 'stage2') AS stage2_structural_dropped,
            count(*) FILTER (stage_failed = 'stage3') AS stage3_content_score_dropped,
            count(*) FILTER (stage_failed = 'stage4') AS stage4_dedup_dropped,
            count(*) FILTER (reason IS NULL) AS final_records,
            (SELECT count(*) FROM commits) + (SELECT count(*) FROM pull_verdicts) AS total FROM {DECISIONS})""",
        "repos_processed": "SELECT repo FROM commits UNION SELECT repo FROM pull_verdicts",
        "collection_limits": _limits(50),
        "profile_funnel": _profile_funnel(),
        "health_sample": f"SELECT repo, number, cast(rank AS int) AS rank FROM {SAMPLE}",
        "health_signals": f"SELECT repo, number, system, doc_url, signal, by_bot FROM {_signal_rows()}",
        "health_examples": f"""SELECT repo, string_agg(concat('"', signal, '" in PR #', number), '; ' ORDER BY i) AS example_signals
            FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, system_pos) AS i
                FROM {_signal_rows()} WHERE signal IS NOT NULL) WHERE i <= 3 GROUP BY repo""",
        "repo_health": f"SELECT * FROM {HEALTH}",
        "healthy_repos": f"SELECT repo AS full_name FROM {HEALTH} WHERE is_native",
        "train_eval_split": f"""SELECT value, side, count(*) AS n_lines
            FROM ({_split("md5(concat('42|', line_no))", "value")}) GROUP BY value, side""",
        "train_eval_split_ordered": _split("line_no", "line_no, value"),
    }
    listed = "SELECT string_agg(concat({0}, '=', {1}), ',' ORDER BY {0}) FROM ({2})"
    reasons = listed.format("reason", "n_dropped", selects["reason_counts"])
    tasks = listed.format("task", "n_records", selects["task_distribution"])
    limits = ", ".join(f"0::bigint AS {name}" for name in report.LIMITS.values())
    selects["run_report"] = f"""SELECT rs.*, {limits}, 'alpaca' AS format, 'all' AS task,
        ({reasons}) AS reasons, ({tasks}) AS tasks FROM ({selects["run_stats"]}) rs"""
    for name in EXCLUSIONS:
        selects[f"excl_{name}"] = f"SELECT repo, sha, coalesce({EXCL[name]}, false) AS excluded FROM described"
    return selects


def all_sql() -> dict[str, str]:
    """Each SELECT behind exactly the common table expressions it needs."""
    ctes = dict(_ctes())
    names = list(ctes)
    result = {}
    for query, select in _selects().items():
        needed, todo = set(), [select]
        while todo:
            for n in referenced(todo.pop(), names):
                if n not in needed:
                    needed.add(n)
                    todo.append(ctes[n])
        # The walk visits its rows once per record, and these are read by several others: compute
        # them once.
        once = {"facts", "described", "scored"}
        kind = {n: "AS MATERIALIZED" if n.endswith("_rows") or n in once else "AS" for n in names}
        parts = ",\n".join(f"{n} {kind[n]} ({ctes[n]})" for n in names if n in needed)
        result[query] = f"WITH RECURSIVE {parts}\n{select}" if parts else select
    return result
