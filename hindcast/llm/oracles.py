"""DuckDB SQL of the plain definitions behind the newer operators."""

# CRC-32 of the UTF-8 bytes of `word` of every row of `words`, byte by byte.
_CRC = """
bytes AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i))),
crcs AS (SELECT w.*, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(hex(encode(word))), 2),
      lambda i: ('0x' || substr(hex(encode(word)), i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM words w, bytes)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

IMPORTANCE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list
  FROM documents),
items AS (
  SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list FROM benchmark),
features AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list) AS word FROM docs)
  GROUP BY ALL),
wanted AS (SELECT word, count(*) AS n FROM (SELECT unnest(list) AS word FROM items) GROUP BY word),
words AS (SELECT word FROM features UNION SELECT word FROM wanted), {_CRC},
buckets AS (SELECT word, crc % 10000 AS bucket FROM crcs),
source AS (SELECT bucket, sum(n) AS s FROM features JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM wanted JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT r.bucket, s, t FROM range(10000) r(bucket)
        LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket))),
sums AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
  FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, len(list)::BIGINT AS n_features,
    CASE WHEN n_features IS NULL THEN 0
      ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight
  FROM docs d LEFT JOIN sums USING (doc_id)),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM weighed),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM numbered
"""

VARIANTS_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) WHERE len(run) >= 7 GROUP BY ALL),
words AS (SELECT *, doc_id || ':' || run AS word FROM runs), {_CRC},
counted AS (
  SELECT CASE WHEN crc % 31 = 0
    THEN substr(run, 1, (crc % len(run))::INT) || substr(run, (crc % len(run))::INT + 2)
    ELSE run END AS w, sum(n)::BIGINT AS n FROM crcs GROUP BY w),
vocabulary AS (SELECT w, n FROM counted WHERE len(w) >= 7 AND n >= 2),
deletions AS (
  SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS d FROM (
    SELECT w, n, unnest(range(len(w)))::INT AS i FROM vocabulary)),
pairs AS (
  SELECT a.w, a.n, b.w AS near, b.n AS near_n
  FROM deletions a JOIN deletions b ON a.i = b.i AND a.d = b.d AND a.w <> b.w
  UNION SELECT a.w, a.n, v.w, v.n FROM deletions a JOIN vocabulary v ON a.d = v.w
  UNION SELECT v.w, v.n, a.w, a.n FROM deletions a JOIN vocabulary v ON a.d = v.w),
best AS (
  SELECT w, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n
  FROM pairs GROUP BY w),
grouped AS (
  SELECT v.w, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.form_n >= 10 * v.n THEN b.form END AS form,
    CASE WHEN b.form_n >= 10 * v.n THEN b.form_n END AS form_n
  FROM vocabulary v LEFT JOIN best b USING (w)),
paths AS (
  SELECT w, w AS reached, form AS next FROM grouped
  UNION ALL SELECT p.w, p.next, g.form FROM paths p JOIN grouped g ON p.next = g.w)
SELECT g.w AS word, n, n_near, g.form, form_n, p.reached AS root
FROM grouped g JOIN paths p ON g.w = p.w AND p.next IS NULL
"""
