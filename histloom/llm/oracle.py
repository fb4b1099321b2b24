"""The registered queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

_WORDS9 = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)

OP9 = f"""
WITH items AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
cut AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS9} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM cut),
spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths),
hits AS (SELECT s.r, s.i, s.n, c.item_id
         FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM spots) s
         JOIN cut c USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items
          FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
           FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_FIELDS12 = "doc_id", "source", "lang", "n_chars", "text"


def _leaf12(**replaced: str) -> str:
    values = [f"CAST({replaced.get(f, f)} AS VARCHAR)" for f in _FIELDS12]
    sized = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(sized)})"


# Fixed value: the reversed polynomial of CRC-32. Bits of the text, lowest of each byte first.
_CRC12 = """xor(list_reduce(
    flatten([[CAST((ascii(c) >> k) & 1 AS BIGINT) for k in range(8)]
             for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END),
    CAST(4294967295 AS BIGINT)), 4294967295)"""


def _steps12(name: str, levels: str, key: str) -> str:
    """Siblings of every leaf of ``levels``, from its level up; 'L' or 'R' and the digest."""
    return f"""
{name} AS (
    SELECT f.t, f.id, list(CASE WHEN o.idx % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '')
                           ORDER BY o.level) FILTER (o.idx IS NOT NULL) AS steps
    FROM {key} f
    LEFT JOIN {levels} o ON o.t = f.t AND o.n > 1 AND o.idx = f.idx >> o.level
    LEFT JOIN {levels} s ON s.t = o.t AND s.level = o.level AND s.idx = xor(o.idx, 1)
    GROUP BY f.t, f.id)"""


def _up12(name: str, leaves: str) -> str:
    return f"""
{name} AS (
    SELECT 0 AS level, t, idx, n, h FROM {leaves}
    UNION ALL
    SELECT level + 1, t, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
    FROM {name} WHERE n > 1 GROUP BY level, t, idx // 2, n)"""


OP12 = f"""
WITH RECURSIVE rows12 AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce('v' || lang, 'n') AS t, {_leaf12()} AS h,
           CASE WHEN {_CRC12} % 7 = 0 THEN {_leaf12(n_chars="n_chars + 1")} ELSE {_leaf12()} END AS shown
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h, id) - 1 AS idx,
           count(*) OVER (PARTITION BY t) AS n FROM rows12),
{_up12("lower_", "leaves")},
tops AS (SELECT t AS id, '' AS t, h, row_number() OVER (ORDER BY t) - 1 AS idx,
                count(*) OVER () AS n FROM lower_ WHERE n = 1),
{_up12("upper_", "tops")},
{_steps12("below", "lower_", "leaves")},
{_steps12("above", "upper_", "tops")},
proofs AS (
    SELECT l.doc_id, l.h AS leaf, l.shown, p.h AS subroot,
           (SELECT h FROM upper_ WHERE n = 1) AS root,
           list_concat(coalesce(b.steps, []), coalesce(a.steps, [])) AS steps
    FROM leaves l JOIN below b ON b.id = l.id JOIN tops p ON p.id = l.t JOIN above a ON a.id = l.t),
folded AS (
    SELECT *, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
           list_reduce(steps, lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END),
                       shown) AS folded_root
    FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

ORACLE = {"op2_topk": OP2, "op9_decontaminate": OP9, "op12_merkle": OP12}
