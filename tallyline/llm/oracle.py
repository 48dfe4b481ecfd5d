"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM docs GROUP BY source),
-- share out; whoever is above twice its size stops there; share the rest again
rounds(n, source, source_size, w, stopped) AS (
  SELECT 0, source, source_size, w, false FROM sources
  UNION ALL
  SELECT n + 1, source, source_size, w,
         stopped OR 2 * 2 * source_size * sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ()
                    <= w * (3 * sum(source_size) OVER ()
                            - 2 * sum(CASE WHEN stopped THEN 2 * source_size ELSE 0 END) OVER ())
  FROM rounds WHERE n <= (SELECT count(*) FROM sources)),
final AS (
  SELECT *, 3 * sum(source_size) OVER ()
            - 2 * sum(CASE WHEN stopped THEN 2 * source_size ELSE 0 END) OVER () AS rest,
         sum(CASE WHEN stopped THEN 0 ELSE w END) OVER () AS ws
  FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN 2 * source_size::DOUBLE
              ELSE w::DOUBLE * rest::DOUBLE / (ws * 2)::DOUBLE END AS target
  FROM final),
queue AS (
  SELECT d.*, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING)::BIGINT AS run
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
takes AS (
  SELECT doc_id, k, size, source, r, run, (r * source_size + run)::DOUBLE / target AS finish
  FROM queue, (VALUES (0), (1)) v(r) WHERE size > 0 AND target > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, r, run ROWS UNBOUNDED PRECEDING) AS total
  FROM takes),
kept AS (
  SELECT doc_id, k, size, sum(size)::BIGINT AS taken FROM served
  WHERE 2 * total <= 3 * (SELECT sum(size) FROM docs) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN kept USING (doc_id, k, size)
"""


_VECTORS = r"""
WITH RECURSIVE rows_ AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND coalesce(
           len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM rows_ a JOIN rows_ b ON a.label = b.label AND a.vec_id <> b.vec_id
   AND a.usable AND b.usable AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id,
       coalesce(c, vec_id) = vec_id AS kept
FROM rows_ LEFT JOIN parts ON parts.a = vec_id LEFT JOIN degrees ON degrees.a = vec_id
"""


# Unsigned CRC-32 of the bytes in a list, byte by byte over the polynomial's table.
_CRC = """
crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""


def _crc(string: str) -> str:
    """Of a string of letters up to U+00FF, whose UTF-8 has one or two bytes each."""
    byte = "CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END"
    data = f"flatten(list_transform(string_split({string}, ''), lambda c: {byte}))"
    folded = f"list_reduce([4294967295::BIGINT] || {data}::BIGINT[], lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]))"
    return f"xor({folded}, 4294967295)"


# A run of lag q is an island of places that equal the place q words before. Of islands with
# the same start and end, the least lag is the period.
_RUNS = rf"""
WITH {_CRC.strip()},
hashed AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words,
         {_crc("doc_id::VARCHAR")} AS h FROM documents, crc_table),
placed AS (
  SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS planted,
         CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a, (h // 10) % 8 AS g8 FROM hashed),
spread AS (
  SELECT doc_id, i, CASE WHEN planted AND i >= a
    THEN words[1 + a + (i - a) % (1 + (n - a) // (3 + g8))] ELSE words[1 + i] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
matches AS (
  SELECT y.doc_id, y.i - x.i AS q, y.i FROM spread x JOIN spread y USING (doc_id, w)
  JOIN placed p ON p.doc_id = y.doc_id
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= p.n),
islands AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period
  FROM islands GROUP BY doc_id, start, length),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
texts AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM spread ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT x.* FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
      OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period,
       1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM placed LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN texts USING (doc_id)
"""

# Two words are near if they lose the same place to become equal, or if one loses a place
# to become the other.
_SPELLING = rf"""
WITH RECURSIVE {_CRC.strip()},
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (
  SELECT run, {_crc("doc_id || ':' || run")} AS h FROM found, crc_table WHERE len(run) >= 6),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word,
         count(*) AS n
  FROM hashed GROUP BY 1 HAVING count(*) >= 5 AND len(word) >= 6),
losses AS (
  SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest
  FROM (SELECT *, unnest(range(len(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n FROM losses x JOIN losses y USING (rest, i) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM losses x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM losses x JOIN words y ON x.rest = y.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS m FROM near GROUP BY word),
forms AS (
  SELECT b.word, min(other) AS form, b.m AS form_n
  FROM best b JOIN near x ON x.word = b.word AND x.n = b.m JOIN words w ON w.word = b.word
  WHERE b.m >= 5 * w.n GROUP BY b.word, b.m),
ways(word, root) AS (
  SELECT word, word FROM words
  UNION SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.root)
SELECT w.word, form, r.root, w.n::BIGINT AS n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words w LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
JOIN ways r ON r.word = w.word AND r.root NOT IN (SELECT word FROM forms)
"""

_TOP = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, len(embedding) AS dim,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.dim = c.dim AND q.row <> c.row WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def statements() -> dict[str, str]:
    return {
        "op4_mixing": _MIX,
        "op9_embedding_dedup": _VECTORS,
        "op11_periodic_runs": _RUNS,
        "op12_spelling": _SPELLING,
        "op13_topk_search": _TOP,
    }
