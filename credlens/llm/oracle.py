"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
w3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 2], ' ')) AS c
       FROM places WHERE i + 2 <= len(ws)),
c3 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM w3 WHERE c > 1) GROUP BY doc_id),
w8 AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 7], ' ')) AS g FROM places WHERE i + 7 <= len(ws)),
c8 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
         SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w8) WHERE c > 1)
       GROUP BY doc_id),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS gap FROM w8 a JOIN w8 b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
islands AS (SELECT doc_id, gap, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM pairs),
runs AS (SELECT doc_id, count(*) + 7 AS n FROM islands GROUP BY doc_id, gap, island),
longest AS (SELECT doc_id, max(n) AS n FROM runs GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
         coalesce(c8.n, 0)::BIGINT AS n_covered_words, coalesce(longest.n, 0)::BIGINT AS longest_repeat
  FROM words w LEFT JOIN dup USING (doc_id) LEFT JOIN c3 USING (doc_id)
  LEFT JOIN c8 USING (doc_id) LEFT JOIN longest USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_covered_words <= 3 * n_words AND longest_repeat <= 100 AS kept,
       n_covered_words, longest_repeat
FROM failed
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM src),
steps AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER ()
            - coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY 2 * s / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM weighed),
level AS (SELECT arg_min(rest, 2 * s / w::DOUBLE) AS rest, arg_min(open_w, 2 * s / w::DOUBLE) AS open_w
          FROM steps WHERE 2 * s * open_w > w * rest),
target AS (SELECT source, s, least(2.0::DOUBLE * s, w * rest::DOUBLE / open_w::DOUBLE)::DOUBLE AS target
           FROM weighed, level),
plan AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 2) ELSE 0 END AS e FROM target),
groups AS (SELECT source, key, sum(size) AS g, count(*) AS n FROM sized GROUP BY ALL),
running AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY key) - g AS before FROM groups),
chosen AS (
  SELECT d.doc_id, d.size, p.s AS source_size, p.target, p.e, p.target - p.e * p.s AS extra, r.before, r.g, r.n
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
  JOIN running r ON d.source IS NOT DISTINCT FROM r.source AND d.key = r.key)
SELECT doc_id, size, source_size, target,
       (e * size + CASE WHEN before + g <= extra THEN size WHEN before > extra OR g = 0 THEN 0
                        WHEN n = 1 THEN CASE WHEN 2 * (extra - before) >= size THEN size ELSE 0 END
                        ELSE floor((extra - before) * size / g) END)::BIGINT AS taken
FROM chosen
"""

OP5 = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM raw),
places AS (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM sized),
windows AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS w FROM places),
hits AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
steps AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true)::INT AS fresh FROM hits),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY ALL),
ordered AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS was,
                   lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a FROM spans),
kept AS (
  SELECT s.doc_id, sum(o.b - o.a) AS removed, count(*) AS runs,
         string_agg(substr(h, 2 * coalesce(was, 0) + 1, 2 * (o.a - coalesce(was, 0))), '' ORDER BY o.a)
         || first(substr(h, 2 * last_b + 1)) AS rest
  FROM ordered o JOIN (SELECT doc_id, max(b) AS last_b FROM spans GROUP BY doc_id) USING (doc_id) JOIN sized s USING (doc_id)
  GROUP BY s.doc_id)
SELECT s.doc_id, s.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
       sha256(from_hex(coalesce(rest, h))) AS kept_sha256
FROM sized s LEFT JOIN kept USING (doc_id)
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP8 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS name, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, rx) AS (VALUES (0, 'assign', '{_ASSIGN}'), (1, 'access', 'AKIA[A-Z0-9]{{12,}}'),
                                 (2, 'hex', '[0-9a-f]{{32,}}'), (3, 'markov', '[A-Za-z0-9+/_=-]{{20,}}')),
found AS MATERIALIZED (
  SELECT r, 0 AS rank, regexp_extract_all(t, '{_ASSIGN}', 0) AS m, regexp_extract_all(t, '{_ASSIGN}', 2) AS v, string_split_regex(t, '{_ASSIGN}') AS g FROM docs
  UNION ALL SELECT r, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]{{12,}}'), NULL, string_split_regex(t, 'AKIA[A-Z0-9]{{12,}}') FROM docs
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9a-f]{{32,}}'), NULL, string_split_regex(t, '[0-9a-f]{{32,}}') FROM docs
  UNION ALL SELECT r, 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{20,}}'), NULL, string_split_regex(t, '[A-Za-z0-9+/_=-]{{20,}}') FROM docs),
each AS (SELECT r, rank, unnest(m) AS m, unnest(coalesce(v, m)) AS v, unnest(g[:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT r, rank, m, v, (sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i))::BIGINT AS stop FROM each),
spans AS (SELECT r, rank, m, v, stop - length(m) AS start, stop FROM placed WHERE rank > 0 OR length(v) >= 8),
base AS (SELECT * FROM spans WHERE rank < 3),
chosen AS (SELECT *, r IN (SELECT r FROM base) AS labelled FROM docs
           WHERE ('0x' || substr(md5(name), 1, 8))::BIGINT < (4000 * 4294967296) // (SELECT count(*) FROM documents)),
tokens AS (SELECT 'random' AS label, v AS token FROM base
           UNION ALL SELECT 'random', to_base64(from_hex(sha256(name))) FROM chosen
           UNION ALL SELECT 'plain', w FROM (SELECT unnest(string_split_regex(t, '[^A-Za-z0-9+/_=-]+')) AS w FROM chosen WHERE NOT labelled)
                     WHERE length(w) BETWEEN 8 AND 19),
steps AS (SELECT label, token, unnest(range(1, length(token) + 1)) AS i FROM tokens),
cells AS (SELECT label, CASE WHEN i > 1 THEN instr('{_ALPHABET}', token[i - 1]) ELSE 0 END AS a, instr('{_ALPHABET}', token[i]) AS b FROM steps),
counts AS (SELECT x.a, y.b, count(*) FILTER (label = 'random') AS random, count(*) FILTER (label = 'plain') AS plain
           FROM range(68) x(a) CROSS JOIN range(68) y(b) LEFT JOIN cells ON cells.a = x.a AND cells.b = y.b GROUP BY ALL),
befores AS (SELECT a, sum(random) AS rr, sum(plain) AS pr FROM counts GROUP BY a),
afters AS (SELECT b, (sum(random) + 0.5::DOUBLE) / (sum(sum(random)) OVER () + 34) AS rs,
                  (sum(plain) + 0.5::DOUBLE) / (sum(sum(plain)) OVER () + 34) AS ps FROM counts GROUP BY b),
weights AS (SELECT a, b, round(1000 * (ln((random + 34 * rs) / (rr + 34)) - ln((plain + 34 * ps) / (pr + 34))))::BIGINT AS w
            FROM counts JOIN befores USING (a) JOIN afters USING (b)),
runs AS (SELECT s.* FROM spans s WHERE rank = 3 AND len(list_distinct(string_split(m, ''))) >= 8
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s.stop AND s.start < b.stop)),
run_steps AS (SELECT *, unnest(range(1, length(m) + 1)) AS i FROM runs),
scored AS (SELECT r, rank, start, stop FROM run_steps JOIN weights
           ON a = CASE WHEN i > 1 THEN instr('{_ALPHABET}', m[i - 1]) ELSE 0 END AND b = instr('{_ALPHABET}', m[i])
           GROUP BY r, rank, start, stop HAVING sum(w) >= 1000 * (stop - start)),
listed AS (SELECT r, rank, start, stop FROM base UNION ALL SELECT * FROM scored),
lines AS (SELECT l.r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base_line,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS line,
                 count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2
          FROM listed l JOIN kinds USING (rank) GROUP BY l.r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base_line, '')) AS base_sha256, coalesce(line, '') AS spans
FROM docs LEFT JOIN lines USING (r)
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP12 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k
             HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
marked AS (SELECT l.*, f.keeper IS NOT NULL AND (l.doc_id IS NULL OR l.doc_id <> f.keeper) AS dropped
           FROM keyed l LEFT JOIN frequent f ON length(l.k) >= 20 AND l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

OP11 = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
grp AS (SELECT DISTINCT lang, source FROM docs),
occ AS (SELECT lang, source, r, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS cl FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lng AS (SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.cl), 0)::HUGEINT AS nl
        FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gs AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n, l.v, l.nl
       FROM grp g JOIN lng l USING (lang) LEFT JOIN cnt c USING (lang, source) GROUP BY g.lang, g.source, l.v, l.nl),
full_grid AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, g.n, g.v, k.cl, g.nl
              FROM gs g JOIN kept k USING (lang) LEFT JOIN cnt c USING (lang, source, term)),
ps AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (n + v) AS p,
              1 + (1000000000 * (cl + 1)) // (nl + v) AS q FROM full_grid),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value
          FROM gs x JOIN gs y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN ps a ON a.lang = x.lang AND a.source = x.source
          LEFT JOIN ps b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term
          GROUP BY x.lang, x.source, y.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM ps WHERE c > 0 AND p > q),
parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value,
                  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP13 = r"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
comps AS (SELECT rid, unnest(q) AS v, unnest(range(1, len(q) + 1)) AS i FROM rows),
anchors AS (SELECT * FROM rows WHERE vec_id % 100 = 0),
scores AS (SELECT a.rid AS arid, c.rid AS crid, sum(x.v * y.v)::BIGINT AS score
           FROM anchors a JOIN comps x ON x.rid = a.rid JOIN comps y ON y.i = x.i
           JOIN rows c ON c.rid = y.rid GROUP BY a.rid, c.rid),
full_scores AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label AS alabel, c.rid AS crid, c.vec_id, c.label,
                       coalesce(s.score, 0) AS score
                FROM anchors a CROSS JOIN rows c LEFT JOIN scores s ON s.arid = a.rid AND s.crid = c.rid),
positives AS (SELECT * FROM (
  SELECT arid, anchor_id, alabel, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id ASC NULLS LAST, crid) AS pidx
  FROM full_scores WHERE label = alabel AND crid <> arid) WHERE pidx <= 5),
negatives AS (SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
                     row_number() OVER (PARTITION BY p.arid, p.pidx ORDER BY n.score DESC, n.vec_id ASC NULLS LAST, n.crid) AS rank
              FROM positives p JOIN full_scores n ON n.arid = p.arid AND n.label <> p.alabel
                AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""

ORACLE = {"op2_repetition_rules": OP2, "op4_source_mix": OP4, "op5_suffix_dedup": OP5, "op8_markov_secrets": OP8, "op9_exact_dedup": OP9,
          "op11_source_divergence": OP11, "op12_line_dedup": OP12,
          "op13_hard_negatives": OP13}
