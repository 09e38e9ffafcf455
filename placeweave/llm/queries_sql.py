"""The DuckDB twins of the queries that SQL can express."""

from placeweave.llm.sharding import SHARDS, SLOTS

# Validity by plain comparison: of the entries of any domain of the host up to
# the fetch day, the latest of the longest domain that has one.
URL_FILTER_SQL = """
WITH p AS (
  SELECT page_id, url,
         nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.$', '')), '') AS host,
         CAST(DATE '2024-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 15))::BIGINT % 31 AS INTEGER) AS DATE) AS fetched_on
  FROM pages
), e AS (
  SELECT CASE WHEN event_id % 10 = 0 AND len(string_split(host, '.')) > 2
              THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS domain,
         CAST(ts AS DATE) AS day, event_id,
         CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS action
  FROM events JOIN p ON user_id = page_id WHERE host IS NOT NULL
), pairs AS (
  SELECT DISTINCT host, fetched_on FROM p WHERE host IS NOT NULL
), suffixes AS (
  SELECT host, fetched_on, array_to_string(string_split(host, '.')[i:], '.') AS domain
  FROM (SELECT *, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM pairs)
), hit AS (
  SELECT s.host, s.fetched_on, s.domain, e.day, e.action,
         row_number() OVER (PARTITION BY s.host, s.fetched_on ORDER BY length(s.domain) DESC, e.day DESC, e.event_id DESC) AS n
  FROM suffixes s JOIN e ON e.domain = s.domain AND e.day <= s.fetched_on
)
SELECT p.page_id, p.url, p.host, p.fetched_on, h.domain AS matched_domain, h.day AS listed_on,
       coalesce(h.action = 'block', FALSE) AS blocked
FROM p LEFT JOIN hit h ON h.host = p.host AND h.fetched_on = p.fetched_on AND h.n = 1
"""

# The table is filled turn by turn: recursion over the turns, with the owners
# so far as a list.
SHARDING_SQL = f"""
WITH RECURSIVE names AS (
  SELECT i AS shard, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard_name FROM range({len(SHARDS)}) t(i)
), hashed AS (
  SELECT shard, shard_name,
         ('0x' || substr(md5('offset:' || shard_name), 1, 15))::BIGINT % {SLOTS} AS place,
         ('0x' || substr(md5('stride:' || shard_name), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS stride
  FROM names
), orders AS (
  SELECT shard, list_transform(range({SLOTS}), lambda j: (place + j * stride) % {SLOTS}) AS preference FROM hashed
), turns AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda j: CAST(-1 AS INTEGER)) AS owner
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(owner[:slot], [CAST(turn % {len(SHARDS)} AS INTEGER)]), owner[slot + 2:])
  FROM (SELECT turn, owner, list_filter(preference, lambda s: owner[s + 1] = -1)[1] AS slot
        FROM turns JOIN orders ON shard = turn % {len(SHARDS)} WHERE turn < {SLOTS})
), full_table AS (
  SELECT owner FROM turns WHERE turn = {SLOTS}
), placed AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INTEGER) AS slot
  FROM documents
), slots AS (
  SELECT CAST(unnest(range({SLOTS})) AS INTEGER) AS slot, unnest(owner) AS shard FROM full_table
)
SELECT doc_id, slot, shard, shard_name FROM placed JOIN slots USING (slot) JOIN names USING (shard)
"""

# Every window of 50 words by its text, without anchors.
SUBSTRING_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM d)
), least AS (
  SELECT content, min(doc_id) AS first_doc FROM starts GROUP BY content
), lost AS (
  SELECT doc_id, i FROM starts JOIN least USING (content) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS j FROM lost)
), every AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d
), rest AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL) AS kept, count(g.j) AS n_removed
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
"""

# Every string of 50 bytes by its hexadecimal form, without a suffix array.
SUFFIX_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), starts AS (
  SELECT doc_id, i, md5(substr(bytes, 2 * i + 1, 100)) AS content
  FROM (SELECT doc_id, bytes, unnest(generate_series(0, length(bytes) // 2 - 50)) AS i FROM d)
), least AS (
  SELECT content, min(doc_id) AS first_doc FROM starts GROUP BY content
), lost AS (
  SELECT doc_id, i FROM starts JOIN least USING (content) WHERE first_doc < doc_id
), flagged AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, TRUE) AS opens FROM lost
), numbered AS (
  SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM flagged
), spans AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span
), bounds AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte, span,
         max(b) OVER (PARTITION BY doc_id) AS last_byte FROM spans
), pieces AS (
  SELECT doc_id, string_agg(substr(bytes, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) AS head, max(last_byte) AS tail
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(bytes) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN bytes ELSE head || substr(bytes, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN bounds USING (doc_id) LEFT JOIN pieces USING (doc_id)
"""

# Every order by plain addition over the 32 sets of failed filters.
FILTER_AUDIT_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), first_of AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(first_id < d.doc_id, FALSE)] AS fails
  FROM d JOIN first_of USING (t) LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: fails[i]) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM flagged GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
       JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), each AS (
  SELECT part, filter_order, step, f, failed, n, good, toxic, list_contains(failed, f) AS fails_it,
         len(list_filter(failed, lambda g: contains(earlier, g))) > 0 AS gone
  FROM sets, steps
), counted AS (
  SELECT part, filter_order, step, f,
         CAST(sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failed = [f] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

# Every key by its text, without filters.
LINE_SQL = """
WITH every AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, len(lines) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM every
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, i, line, n_lines, coalesce(keeper <> doc_id, FALSE) AS lost FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id, n_lines
"""

# Terms are counted whole, and every pair of sources over every kept term.
DIVERGENCE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT doc_id, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), per_group AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS big_n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(big_n + v AS HUGEINT) AS HUGEINT) AS p
  FROM per_group g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 1)) // CAST(any_value(v) + any_value(total) AS HUGEINT) AS HUGEINT) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(big_n) AS total FROM per_group GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), rows_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM per_group a JOIN per_group b ON b.lang = a.lang AND b.source <> a.source
       LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_of
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
