"""SQL (DuckDB) that gives the rows of the registered queries that SQL can express."""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM lists, range(1, 6) AS t(m) WHERE len(w) >= m),
counts AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS left_part, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS right_part
  FROM counts, range(1, 5) AS t(k) WHERE m > 1 AND k < m),
costed AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, t.n, ((1000 * c.a::HUGEINT * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.left_part JOIN counts y ON y.lang = c.lang AND y.phrase = c.right_part JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM costed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest(flatten([[array_to_string(string_split(phrase, ' ')[i : j], ' ') FOR j IN range(i + 1, m + 1)] FOR i IN range(1, m + 1)])) AS phrase, m AS outer_m, a AS outer_a FROM counts WHERE m > 2),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = b.lang AND o.phrase = b.phrase AND o.outer_m > b.m AND 100 * o.outer_a >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""

OP12 = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT a.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * l.n * t.nn) // t.ll))))::BIGINT AS score
  FROM asked a JOIN tf ON tf.term = a.term JOIN weights w ON w.term = a.term JOIN lengths l ON l.doc_id = tf.doc_id, totals t GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""

_CASE = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_NAMES = "".join(_CASE.get(c, c) for c in "password|passwd|secret|token|api_?key")
#: The lengths asked for stand in the patterns of runs: a run too short holds no other match.
_KINDS = [("assign", f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 12, 2), ("access", "AKIA[A-Z0-9]{14,}", 18, 0), ("hex", "[0-9a-f]{16,}", 16, 0),
  ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0), ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1, 0), ("url", r"[a-z][a-z0-9+.-]{0,15}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", 1, 0)]
#: A match begins where the texts between matches and the matches before it end.
_FOUND = " UNION ALL ".join(
    f"""SELECT row, {i} AS nth, '{kind}' AS kind, list_sum([length(x) FOR x IN gaps[1 : j]]) + coalesce(list_sum([length(x) FOR x IN whole[1 : j - 1]]), 0) AS start, length(whole[j]) AS size FROM (
  SELECT row, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS part, unnest(range(1, len(whole) + 1)) AS j FROM docs)
  WHERE length(part[j]) >= {least}"""
    for i, (kind, pattern, least, group) in enumerate(_KINDS)
)
OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
marks AS (SELECT row, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, nth) FILTER (nth < 3), '') AS base, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, nth) AS spans FROM found GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN marks USING (row)"""

SQL = {"op11_branch_and_bound": OP11, "op12_norm_buckets": OP12, "op13_blob_ledger": OP13}
