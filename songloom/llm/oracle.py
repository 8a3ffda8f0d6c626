"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: crc32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i, 1))::UBIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""


def crc32(text: str) -> str:
    return CRC32.format(text)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, nodes: str, group: str, levels: int) -> list[str]:
    """Levels of a tree over nodes (group, r, h): name0, name1, ... with the digests beside each node."""
    out = []
    for i in range(levels + 1):
        source = nodes if i == 0 else f"""SELECT g, r // 8 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {name}{i - 1} GROUP BY g, r // 8"""
        run = "(PARTITION BY g, r // 8 ORDER BY r ROWS BETWEEN {})"
        out.append(f"""{name}{i} AS (SELECT g, r, h, count(*) OVER (PARTITION BY g) AS n,
 coalesce(string_agg(h, '') OVER {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS a,
 coalesce(string_agg(h, '') OVER {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS z FROM ({source}))""")
    return out


def manifest_sql(levels: int = 8, top: int = 4) -> str:
    """For up to 8**levels rows of a language and 8**top languages."""
    parts = [
        f"""leaves AS (SELECT *, {_leaf('text')} AS leaf,
 CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents)""",
        "placed AS (SELECT doc_id, lang AS g, leaf AS h, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves)",
        *_tree("t", "SELECT g, r, h FROM placed", "g", levels),
        f"subs AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, h, g AS lang FROM t{levels})",
        *_tree("s", "SELECT g, r, h FROM subs", "g", top),
    ]
    joins = " ".join(f"JOIN t{i} ON t{i}.g IS NOT DISTINCT FROM p.g AND t{i}.r = p.r // {8**i}" for i in range(levels))
    joins += " JOIN subs ON subs.lang IS NOT DISTINCT FROM p.g " + " ".join(f"JOIN s{i} ON s{i}.r = subs.r // {8**i}" for i in range(top))
    steps = [f"t{i}" for i in range(levels)] + [f"s{i}" for i in range(top)]
    taken = ", ".join(f"CASE WHEN {x}.n > 1 THEN {{'a': {x}.a, 'z': {x}.z}} END" for x in steps)
    parts.append(f"paths AS (SELECT p.doc_id, p.h AS leaf, coalesce(p.other, p.h) AS used, subs.h AS subroot, (SELECT h FROM s{top}) AS root, list_filter([{taken}], lambda x: x IS NOT NULL) AS steps FROM placed p {joins})")
    fold = "list_reduce(list_prepend({'a': used, 'z': ''}, steps), lambda h, x: {'a': sha256(x.a || h.a || x.z), 'z': ''}).a"
    return f"""WITH {', '.join(parts)}, ends AS (SELECT *, {fold} AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.a || x.z), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends"""

NGRAM_JOIN = r"""WITH RECURSIVE w AS (
 SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT i, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END AS g FROM w),
e AS (SELECT i, len(g) AS n, hash(unnest(g)) AS gram FROM s),
o AS (SELECT a.i AS x, b.i AS y, any_value(a.n + b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.gram = b.gram AND a.i <> b.i GROUP BY a.i, b.i),
l AS (SELECT x, y FROM o WHERE 100 * c >= 80 * (n - c)),
reach AS (SELECT i AS x, i AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(any_value(s.g))::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN reach r ON r.x = s.i JOIN s t ON t.i = r.y GROUP BY s.i, s.doc_id"""

HARD_NEGATIVES = """WITH v AS (
 SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, a.vec_id AS anchor_id, b.i AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.i <> b.i AND len(a.x) = len(b.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

TOP_K = """WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
pair AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pair
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
