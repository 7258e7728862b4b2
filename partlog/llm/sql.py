"""DuckDB SQL for the corpus queries whose rows it can express, by plain definitions.

None of them shares a method with the operator that it is compared with: windows and
shingles are strings, pairs come from joins on whole strings, components from recursion.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: Nodes of ``links`` (a, b), both ways, with the smallest node that each can reach.
REACHED = """reached(node, other) AS (
      SELECT a, b FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other),
    components AS (SELECT node, least(node, min(other)) AS component_id FROM reached GROUP BY node)"""

OP1 = f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)),
windows AS (
  SELECT doc_id, place, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS said,
    count(*) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n, word
  FROM words),
repeats AS (
  SELECT doc_id, place, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, said ORDER BY doc_id, place) > 1 AS again
  FROM windows),
judged AS (
  SELECT doc_id, place, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM repeats)
SELECT doc_id, count(word) AS n_words, count(word) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN judged USING (doc_id) GROUP BY doc_id"""

OP6 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y USING (s)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 75 * (p.n + q.n - common)),
{REACHED}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN components ON node = d.doc_id"""

OP9 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.9),
{REACHED}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id LEFT JOIN components ON node = vec_id"""

OP13 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL)
  GROUP BY ALL),
checked AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
        ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2))
      ELSE run END AS word FROM checked)
  GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS (
  SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word),
best AS (
  SELECT word, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n, count(*) AS n_near FROM near GROUP BY word),
forms AS (
  SELECT word, CASE WHEN form_n >= 5 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps(word, there) AS (
  SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.there WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.there AS root FROM steps s JOIN forms f ON f.word = s.there WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

SQL = {
    "op1_substring_dedup": OP1,
    "op6_ngram_jaccard": OP6,
    "op9_embedding_dedup": OP9,
    "op13_spelling_variants": OP13,
}
