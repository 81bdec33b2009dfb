"""The registered queries in SQL, where SQL can say them.

Patterns are written out: these are the questions, not the library's answers.  Encoders,
boosted trees, shards and searches that may miss have no form in SQL; tests hold those
queries against brute force.
"""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
    FROM documents),
places AS (
    SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have
    FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * both_have >= 85 * (s.n + t.n - both_have)),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

# kind, its place in the list, pattern, group, least length
_SECRETS = (
    (
        "assign",
        0,
        r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, r"[0-9a-f]+", 0, 24),
    ("pem", 3, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,250}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", 5, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)

OP2 = (
    "WITH "
    + ", ".join(
        rf"""
hits_{kind} AS (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{pattern}')) AS hit,
        generate_subscripts(regexp_extract_all(coalesce(text, ''), '{pattern}'), 1) AS i
    FROM documents),
gaps_{kind} AS (
    SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{pattern}')) AS gap,
        generate_subscripts(string_split_regex(coalesce(text, ''), '{pattern}'), 1) AS i
    FROM documents),
spans_{kind} AS (
    SELECT doc_id, '{kind}' AS kind, {rank} AS place, hit,
        sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
    FROM hits_{kind} JOIN gaps_{kind} USING (doc_id, i))"""
        for kind, rank, pattern, _, _ in _SECRETS
    )
    + ", spans AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, kind, place, stop - length(hit) AS start, stop FROM spans_{kind} "
        f"WHERE length(regexp_extract(hit, '{pattern}', {group})) >= {least}"
        for kind, _, pattern, group, least in _SECRETS
    )
    + """),
told AS (
    SELECT doc_id, kind, place, start,
        kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM spans)
SELECT d.doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place < 3), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
GROUP BY d.doc_id
"""
)

OP3 = rf"""
WITH docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
        len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols
    FROM documents),
sized AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM docs GROUP BY source),
weighed AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
    FROM sized),
levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
targets AS (
    SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
keyed AS (
    SELECT doc_id, source, size,
        -ln((CAST(('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 13))
                AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
        / greatest(least(1.0::DOUBLE - CAST(symbols AS DOUBLE) / greatest(CAST(size AS DOUBLE), 1.0::DOUBLE),
            1.0::DOUBLE), 0.05::DOUBLE) AS drawn
    FROM docs),
ahead AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY drawn, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM keyed),
rest AS (
    SELECT a.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
    FROM ahead a JOIN targets t ON a.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(size * (whole + CASE WHEN target - whole * source_size > 0
        AND CAST(before AS DOUBLE) + size / 2.0::DOUBLE <= target - whole * source_size
        THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rest
"""

OP5 = """
WITH told AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
placed AS (
    SELECT *, first_value(page_id) OVER same AS first_id, payload_bytes >= 100 AND row_number() OVER same > 1 AS again
    FROM told WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id))
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first_id END AS refers_to
FROM placed
"""

OP6 = rf"""
WITH seen AS (
    SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '') AS host,
        regexp_replace(html,
            '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS html
    FROM pages),
bodies AS (
    SELECT page_id, host, regexp_replace(regexp_replace(html,
        '(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|nav|article|footer|header|section|title|head|body|html)([\x20\x09-\x0D][^>]*)?/?>',
        chr(10), 'g'), '<[^>]*>', '', 'g') AS body
    FROM seen),
lines AS (
    SELECT page_id, host, unnest(string_split(body, chr(10))) AS line,
        generate_subscripts(string_split(body, chr(10)), 1) AS i
    FROM bodies),
trimmed AS (
    SELECT *, regexp_replace(line, '^{SPACE}+|{SPACE}+\z', '', 'g') AS bare FROM lines),
counted AS (
    SELECT host, bare, count(DISTINCT page_id) AS n FROM trimmed WHERE bare <> '' GROUP BY host, bare),
totals AS (SELECT host, count(*) AS n_pages FROM bodies GROUP BY host),
common AS (
    SELECT c.host, c.bare, true AS gone FROM counted c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
    WHERE n > 0.05::DOUBLE * n_pages),
marked AS (
    SELECT t.*, coalesce(c.gone, false) AS gone
    FROM trimmed t LEFT JOIN common c ON t.host IS NOT DISTINCT FROM c.host AND t.bare = c.bare)
SELECT page_id, host, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
    CAST(count(*) FILTER (bare <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped
FROM marked GROUP BY page_id, host
UNION ALL SELECT page_id, host, NULL, 0, 0 FROM bodies WHERE body IS NULL
"""

OP7 = rf"""
WITH told AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
        sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')) AS text_sha256
    FROM documents),
ranked AS (
    SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
    FROM told)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM ranked
"""

# CRC-32 of the UTF-8 bytes of `m`, bit by bit.
_CRC = """xor(list_reduce(
        list_transform(range(1, strlen(m) + 1), lambda i: CAST('0x' || substr(hex(encode(m)), 2 * i - 1, 2) AS BIGINT)),
        lambda c, b: list_reduce(range(8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b)),
        4294967295::BIGINT), 4294967295::BIGINT)"""

OP11 = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS m, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
summed AS (SELECT run, n, {_CRC} AS h FROM runs),
changed AS (
    SELECT n, CASE WHEN h % 31 = 0
        THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM summed),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT x.word AS a, x.n AS n_a, y.word AS b, y.n AS n_b
    FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
    UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
    UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
near AS (SELECT a AS word, count(*) AS n_near FROM pairs GROUP BY a),
forms AS (
    SELECT a AS word, b AS form, n_b AS form_n FROM pairs WHERE n_b >= 10 * n_a
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY n_b DESC, b) = 1),
walk AS (
    SELECT word, form AS root FROM forms
    UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root),
ends AS (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN near USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""

_TERMS = r"""regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12 = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
totals AS (SELECT count(*) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM docs WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
held AS (
    SELECT doc_id, n, term, count(*) AS tf
    FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM held, totals GROUP BY term),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {
    "op1_ngram_join": OP1,
    "op2_secret_scans": OP2,
    "op3_source_mixing": OP3,
    "op5_warc": OP5,
    "op6_line_dedup": OP6,
    "op7_exact_dedup": OP7,
    "op11_spelling_variants": OP11,
    "op12_ranked_search": OP12,
}
