"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

from .licenses import NOTICES, PHRASES, SLACK

COVER_TREE = """
  WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  ), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
  ), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
  )
  SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(r.low, e.vec_id) AS kept
  FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = e.vec_id
"""


def _templates() -> str:
    rows = []
    for t, (text, label, base) in enumerate([(*p, "true") for p in PHRASES] + [(*n, "false") for n in NOTICES]):
        words = text.split()
        rows += [f"({t}, '{label}', {base}, {i}, {len(words) - 1}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return ", ".join(rows)


LICENSE_SCAN = f"""
  WITH t(template, label, base, tpos, grams, t0, t1) AS (VALUES {_templates()}),
  d AS (
    SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
  ), g AS (
    SELECT uid, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, unnest(range(len(w))) AS pos FROM d WHERE len(w) > 1
  ), diagonals AS (
    SELECT uid, template, label, base, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS found FROM g JOIN t ON a = t0 AND b = t1 GROUP BY ALL
  ), runs AS (
    SELECT *, sum(new) OVER (PARTITION BY uid, template ORDER BY diagonal) AS run FROM (
      SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY uid, template ORDER BY diagonal) > {SLACK}, true) THEN 1 ELSE 0 END AS new FROM diagonals)
  ), spans AS (
    SELECT uid, template, label, base, grams, run, len(list_distinct(flatten(list(found)))) AS votes, min(diagonal) AS start FROM runs GROUP BY ALL
  ), marked AS (
    SELECT *, base AND votes = grams AS place, NOT base AND votes >= 0.75 * grams AS notice FROM spans
  ), found AS (
    SELECT uid, count(*) FILTER (WHERE place) AS n_base, min(start) FILTER (WHERE place) AS first_word, max(start) FILTER (WHERE place) AS last_word,
      coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE place)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE place OR notice)), ','), '') AS labels,
      coalesce(max(CASE WHEN place THEN 1.0::DOUBLE WHEN notice THEN votes::DOUBLE / grams END), 0.0) AS score
    FROM marked GROUP BY uid
  )
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
  FROM d LEFT JOIN found USING (uid)
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round compares every part with every entry."""
    steps = [f"""
      v AS (SELECT row_number() OVER () AS uid, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
      w AS (SELECT len(e) // {parts} AS w FROM v WHERE len(e) % {parts} = 0 ORDER BY vec_id LIMIT 1),
      x AS MATERIALIZED (SELECT uid, vec_id, p, list_transform(range(1, w + 1), lambda i: floor({scale} * e[p * w + i]::DOUBLE)::BIGINT) AS c, w FROM v, w, range({parts}) r(p) WHERE len(e) = {parts} * w),
      b0 AS (SELECT p, j, c FROM (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id, uid) - 1 AS j FROM x) WHERE j < {entries})"""]
    square = "list_sum(list_transform(range(1, w + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))"
    for r in range(rounds + 1):
        steps.append(f"""
      a{r} AS MATERIALIZED (SELECT uid, p, any_value(x.c) AS c, any_value(w) AS w, min({square}) AS d, arg_min(j, {square} * {entries} + j) AS j FROM x JOIN b{r} b USING (p) GROUP BY uid, p)""")
        if r < rounds:
            steps.append(f"""
      b{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
        SELECT p, j, list((s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY i) AS c FROM (SELECT p, j, i, sum(c[i]) AS s, count(*) AS n FROM (SELECT p, j, c, unnest(range(1, w + 1)) AS i FROM a{r}) GROUP BY p, j, i) GROUP BY p, j) m ON m.p = b.p AND m.j = b.j)""")
    return f"""WITH {','.join(steps)},
      coded AS (SELECT uid, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY uid)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM b{rounds}) AS codebooks_sha256 FROM coded JOIN v USING (uid)"""


VECTOR_CODES = _vector_codes()

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)), lambda z, b: list_reduce(list_prepend(xor(z, b), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)))"
CONVERSATION_TRIE = f"""
  WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  ), c AS (
    SELECT c, c - c % 5 AS base, {_CRC.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM t)
  ), rows AS (
    SELECT c.c, 0 AS half, pos, role, text FROM c JOIN t ON t.c = base AND pos <= h UNION ALL SELECT c.c, 1, pos, role, text FROM c JOIN t USING (c) WHERE pos > h
  ), steps AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY half, pos) AS depth FROM rows
  ), paths AS MATERIALIZED (  -- every conversation's prefixes, each known by a digest of its turns
    SELECT c, depth, sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth)) AS path, strlen(text) AS bytes FROM (SELECT * FROM steps)
    UNION ALL SELECT c, 0, '', 0 FROM c
  ), lens AS (
    SELECT c, max(depth) AS len FROM paths GROUP BY c
  ), nodes AS MATERIALIZED (
    SELECT depth, path, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '') AS ends FROM paths JOIN lens USING (c) GROUP BY depth, path
  ), up AS MATERIALIZED (  -- every node with each node above it, itself included
    SELECT x.depth AS d, x.path AS p, x.n, x.bytes, q.depth, q.path FROM nodes x JOIN paths q ON q.c = x.conv_id AND q.depth <= x.depth
  ), kids AS (
    SELECT depth, path, count(*) AS n_children FROM up WHERE d = depth + 1 GROUP BY ALL
  ), sums AS (
    SELECT up.depth, up.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n - 1) * bytes)::BIGINT AS saved FROM up LEFT JOIN kids k ON k.depth = up.d AND k.path = up.p GROUP BY ALL
  ), above AS (
    SELECT x.d, x.p, y.conv_id AS parent FROM up x JOIN nodes y ON y.depth = x.depth AND y.path = x.path WHERE x.d = x.depth + 1
  )
  SELECT conv_id, x.depth::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(ends) AS ends_sha256
  FROM nodes x JOIN sums s ON s.depth = x.depth AND s.path = x.path LEFT JOIN kids k ON k.depth = x.depth AND k.path = x.path LEFT JOIN above a ON a.d = x.depth AND a.p = x.path
"""
