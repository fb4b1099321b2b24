"""The given tables seen as project history.

The given tables hold no repository history, so each query reads them through one of these views.
A view is one SQL text that Spark and DuckDB both run; the few differing spellings come from the
dialect. Every row and the whole of every text of the underlying tables is used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PREFIXES = (
    "Fix", "Add", "fix(core): add", "net/http: update", "Merge branch", "Revert", "WIP",
    "Template", "Updates", "", "Bump 1.2", "release: v2.0",
)
SUBJECTS = (
    "https://example.org/a/1", "ABC-123", "update", "fix bug in the code", "a b c", "parser tests",
)
MORE_PREFIXES = ("Ändert", "Remove")
PATHS = (
    "src/a.py", "web/b.tsx", "img/c.png", "poetry.lock", ".gitignore", "docs/d.md",
    "mydist/e.js", "package.json", "setup.py", "conf/f.yaml", "Makefile", "lib/G.GO", "a b c",
)
CHANGE_TYPES = ("ADD", "MODIFY", "DELETE", "RENAME", "COPY", "UNKNOWN")


@dataclass(frozen=True)
class Dialect:
    folder: str | None = None  # None: DuckDB with registered tables

    def table(self, name: str) -> str:
        return name if self.folder is None else f"parquet.`{self.folder}/{name}.parquet`"

    def seconds(self, expr: str) -> str:
        """Timestamp of a Unix time in seconds."""
        if self.folder is None:
            return f"make_timestamp(({expr}) * 1000000)"
        return f"timestamp_seconds({expr})"

    def joined(self, value: str, order: str) -> str:
        """Values of a group in order, one per line."""
        if self.folder is None:
            return f"string_agg({value}, chr(10) ORDER BY {order})"
        pairs = f"array_sort(collect_list(struct({order} AS o, {value} AS v)))"
        return f"array_join(transform({pairs}, p -> p.v), chr(10))"

    def numbers(self, n: str) -> str:
        """Lateral relation p(pos) of 0 .. n-1."""
        if self.folder is None:
            return f"LATERAL (SELECT unnest(range(0, {n}))) AS p(pos)"
        some = f"sequence(0, cast({n} AS int) - 1)"
        return f"LATERAL explode(CASE WHEN {n} > 0 THEN {some} ELSE array() END) AS p(pos)"


def _pick(values: tuple[str, ...], index: str) -> str:
    quoted = "|".join(values).replace("'", "''")
    return f"split_part('{quoted}', '|', cast({index} AS int) + 1)"


def _views(d: Dialect) -> dict[str, str]:
    t = d.table
    message_pick = f"""CASE
        WHEN doc_id % 20 < 12 THEN concat({_pick(PREFIXES, "doc_id % 20")}, ' ')
        WHEN doc_id % 20 < 18 THEN concat({_pick(SUBJECTS, "doc_id % 20 - 12")}, chr(10))
        ELSE concat({_pick(MORE_PREFIXES, "doc_id % 20 - 18")}, ' ') END"""
    trailers = """CASE
        WHEN doc_id % 6 = 0 THEN concat(chr(10), 'Signed-off-by: D <d@x.org>', chr(10), chr(10),
             'Reviewed-by: R', chr(10), ' ', chr(10), 'tail line', chr(10))
        WHEN doc_id % 6 = 3 THEN concat(chr(10), chr(10), 'Fixes: 12', chr(10), '(cherry picked from 1)')
        ELSE '' END"""
    talks = f"""(SELECT doc_id, text,
        doc_id % (SELECT max(conv_id) + 1 FROM {t("conversations")}) AS talk FROM {t("documents")})"""
    path = _pick(PATHS, "(doc_id + pos) % 13")
    change = _pick(CHANGE_TYPES, "(doc_id + pos) % 6")
    return {
        "fx_commits": f"""
            SELECT source AS repo, md5(cast(doc_id AS string)) AS sha,
                concat({message_pick}, text, {trailers}) AS message,
                CASE doc_id % 17 WHEN 0 THEN 'dependabot[bot]' WHEN 1 THEN 'mybot'
                    ELSE concat('dev', doc_id % 7) END AS author,
                CASE doc_id % 17 WHEN 1 THEN NULL WHEN 2 THEN 'build-bot'
                    ELSE 'd@x.org' END AS author_email,
                {d.seconds("1609459200 + doc_id * 3600")} AS author_ts,
                doc_id % 23 = 0 AS is_merge, doc_id
            FROM {t("documents")}""",
        "fx_files": f"""
            SELECT source AS repo, md5(cast(doc_id AS string)) AS sha, cast(pos AS int) AS pos,
                CASE WHEN (doc_id + pos) % 6 = 3 THEN concat('old/', {path}) ELSE {path} END AS old_path,
                CASE WHEN (doc_id + pos) % 12 = 2 THEN NULL WHEN (doc_id + pos) % 12 = 8 THEN ''
                    ELSE {path} END AS new_path,
                CASE WHEN doc_id % 31 = 0 THEN NULL ELSE {change} END AS change_type,
                CASE pos WHEN 0 THEN text WHEN 1 THEN concat('@@ ', text) ELSE NULL END AS diff,
                n_chars % 50 + pos AS additions, doc_id % 9 AS deletions
            FROM {t("documents")},
                {d.numbers("(CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 1 + doc_id % 3 END)")}""",
        "fx_orders": f"""
            SELECT concat('r', o_custkey % 25) AS repo, cast(o_orderkey AS string) AS sha
            FROM {t("orders")}""",
        "fx_order_files": f"""
            SELECT concat('r', o_custkey % 25) AS repo, cast(o_orderkey AS string) AS sha,
                cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                    l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax,
                    l_returnflag, l_linestatus) AS int) AS pos,
                cast(NULL AS string) AS old_path,
                concat('src/', l_partkey, '.', lower(l_returnflag)) AS new_path,
                'MODIFY' AS change_type, concat(l_linestatus, chr(10), l_returnflag) AS diff,
                cast(l_quantity AS bigint) AS additions, cast(l_linenumber AS bigint) AS deletions
            FROM {t("orders")} JOIN {t("lineitem")} ON o_orderkey = l_orderkey""",
        "fx_branches": f"""
            SELECT concat('r', o_custkey % 25) AS repo, o_orderpriority AS branch,
                o_orderpriority = '1-URGENT' AS is_default, cast(o_orderkey AS string) AS sha,
                o_orderdate AS author_ts
            FROM {t("orders")}
            UNION ALL
            SELECT concat('r', o_custkey % 25), 'release', false, cast(o_orderkey AS string), o_orderdate
            FROM {t("orders")} WHERE o_orderstatus = 'P'""",
        # One pull request per document; its talk is one of the conversations, all turns of it.
        "fx_pulls": f"""
            SELECT concat('r', doc_id % 5) AS repo, doc_id AS number,
                split_part(coalesce(c.body, ''), chr(10), 1) AS title,
                concat(coalesce(c.body, ''),
                    CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(chr(10), 'Fixes #', doc_id % 40,
                        ', issues/', doc_id * 7 % 40, ' and pull/3, #007') END,
                    CASE WHEN doc_id % 7 = 0 THEN concat(' pulls/', 6000 + doc_id % 4 * 10) ELSE '' END,
                    CASE WHEN doc_id % 31 = 0 THEN ' #1234567890123456789012345' ELSE '' END,
                    CASE WHEN doc_id % 6 = 0 THEN concat(' <!-- t', chr(10), ' --> <!-- open') ELSE '' END
                ) AS body,
                d.text AS diff,
                {d.seconds("1640995200 + doc_id * 7200")} AS updated_at,
                CASE WHEN doc_id % 9 = 8 THEN NULL
                    ELSE {d.seconds("1640991600 + doc_id * 7200")} END AS merged_at
            FROM {talks} d LEFT JOIN (SELECT conv_id, {d.joined("text", "turn")} AS body
                FROM {t("conversations")} GROUP BY conv_id) c ON c.conv_id = d.talk""",
        "fx_comments": f"""
            SELECT concat('r', doc_id % 5) AS repo, doc_id AS number, cast(turn AS int) AS pos,
                concat('src/', turn, '.py') AS path, concat('@@ -', turn, ' +1 @@') AS diff_hunk,
                c.text AS body, CASE WHEN turn % 4 = 3 THEN NULL ELSE concat('u', turn) END AS author
            FROM {talks} d JOIN {t("conversations")} c ON c.conv_id = d.talk
            WHERE role = 'assistant'""",
        "fx_labels": f"""
            SELECT concat('r', doc_id % 5) AS repo, doc_id AS number, cast(turn AS int) AS pos,
                concat(role, '-', turn) AS name
            FROM {talks} d JOIN {t("conversations")} c ON c.conv_id = d.talk
            WHERE role <> 'assistant'""",
        "fx_issues": f"""
            SELECT concat('r', pos) AS repo,
                cast(CASE WHEN item_id % 10 = 9 THEN item_id + 5991 ELSE item_id END AS decimal(38, 0)) AS number,
                CASE WHEN item_id % 5 = 0 THEN '<!-- template -->' WHEN item_id % 7 = 0 THEN NULL
                    ELSE text END AS body
            FROM {t("benchmark")}, {d.numbers("5")}""",
        "fx_repo_sizes": f"""
            SELECT concat('r', r_regionkey) AS full_name,
                CASE WHEN r_regionkey = 4 THEN NULL ELSE cast(r_regionkey * 2000 AS bigint) END AS open_issues
            FROM {t("region")}""",
        "fx_closed": f"""
            SELECT concat('r', user_id % 20) AS repo, event_id AS number, event_type AS title,
                CASE WHEN user_id % 4 = 3 AND event_type = 'error' THEN
                    CASE event_id % 4 WHEN 0 THEN 'Reviewed-on: https://x' WHEN 1 THEN 'add2'
                        WHEN 2 THEN 'see gitlab.com/a/b/-/merge_requests/1' ELSE 'Internally Reviewed' END
                    ELSE props END AS body,
                CASE WHEN user_id % 20 IN (4, 8, 12) AND event_type = 'error' THEN 'GopherBot'
                    ELSE concat('u', user_id) END AS author_login,
                ts AS updated_at,
                CASE WHEN event_type IN ('purchase', 'signup') AND user_id % 20 > 2
                    THEN ts - interval '1' hour END AS merged_at
            FROM {t("events")}""",
        "fx_releases": f"""
            SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN 'v' ELSE '' END,
                    CASE WHEN p_partkey % 11 = 0 THEN '0' ELSE '' END, p_size, '.', p_partkey % 10,
                    '.', p_partkey % 7,
                    split_part('|-rc.1|+b1|.x|-01|-alpha.beta-2+x.y| |-', '|', cast(p_partkey % 8 AS int) + 1)
                ) AS tag_name,
                p_brand AS repo, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS title,
                CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS body,
                CASE WHEN p_partkey % 6 = 0 THEN NULL
                    ELSE {d.seconds("1577836800 + p_partkey * 3601")} END AS published_at
            FROM {t("part")}""",
        "fx_repo_listing": f"""
            SELECT s_suppkey AS pos, concat('o', s_nationkey, '/', s_suppkey % 40) AS full_name,
                s_suppkey % 4 = 0 AS private,
                CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN ''
                    ELSE concat('lang', s_suppkey % 3) END AS language,
                CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE cast(floor(abs(s_acctbal)) AS int) END AS stars,
                CASE WHEN s_suppkey % 8 = 0 THEN NULL
                    ELSE {d.seconds("1577836800 + s_suppkey * 86400")} END AS updated_at
            FROM {t("supplier")}""",
        "fx_lines": f"""
            SELECT conv_id * 1000 + turn AS line_no,
                CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN '   '
                    ELSE concat(role, ': ', replace(text, chr(10), ' ')) END AS value
            FROM {t("conversations")}""",
    }


def duckdb_views() -> dict[str, str]:
    return _views(Dialect())


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "documents")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame over the parquet tables."""
    return spark.sql(_views(Dialect(sf_dir.rstrip("/")))[name])


def referenced(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]
