"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

import string

from sparkloom.llm import codes, mixing, near, quality, warc

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP1 = f"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, {mixing.DIGITS}) AS BIGINT) AS hash
    FROM documents
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.MOST} * source_size AS most FROM sizes
), ordered AS (
    SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.SHARE} AS budget, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
        CAST(coalesce(sum(most) OVER before, 0) AS BIGINT) AS taken_before, CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_before
    FROM weighed WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
    SELECT *, (budget - taken_before) / (all_weight - weight_before) * weight > most AS is_full FROM ordered
), spent AS (
    SELECT *, CAST(coalesce(sum(most) FILTER (is_full) OVER (), 0) AS BIGINT) AS gone, CAST(coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS BIGINT) AS gone_weight FROM filled
), owed AS (
    SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE (budget - gone) / (all_weight - gone_weight) * weight END AS target FROM spent
), whole AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM owed
), groups AS (
    SELECT source, hash, CAST(sum(size) AS BIGINT) AS size FROM docs GROUP BY source, hash
), running AS (
    SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY hash) AS BIGINT) AS upto FROM groups
), more AS (
    SELECT r.source, r.hash, CASE WHEN r.upto <= w.target - w.whole * w.source_size OR 2 * (w.target - w.whole * w.source_size) >= r.upto - r.size + r.upto THEN 1 ELSE 0 END AS more
    FROM running r JOIN whole w ON r.source IS NOT DISTINCT FROM w.source
)
SELECT d.doc_id, d.size, w.source_size, w.target, d.size * (w.whole + m.more) AS taken, w.whole + m.more AS repeats
FROM docs d JOIN whole w ON d.source IS NOT DISTINCT FROM w.source JOIN more m ON d.source IS NOT DISTINCT FROM m.source AND d.hash = m.hash
"""

OP3 = f"""
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, max(page_id) AS first FROM payloads WHERE payload_bytes >= {warc.LEAST} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

OP5 = f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {near.SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {near.SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {near.SHINGLE - 2})]) END AS s FROM texts
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""

OP7 = """
WITH vectors AS (
    SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""



def _assigned(books: str) -> str:
    """Of each part its nearest entry of the codebooks and the squared distance."""
    near = f"SELECT vec_id, label, p, x, {{'d': CAST(list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)]) AS BIGINT), 'e': e}} AS near FROM parts JOIN {books} USING (p)"
    return f"SELECT vec_id, label, p, x, least.d AS d, least.e AS e FROM (SELECT vec_id, label, p, x, min(near) AS least FROM ({near}) GROUP BY vec_id, label, p, x)"


def _moved(books: str, assigned: str) -> str:
    means = f"SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {assigned}) GROUP BY p, e, i"
    return f"SELECT p, e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM ({means}) GROUP BY p, e) m USING (p, e)"


OP12 = f"""
WITH kept AS (
    SELECT vec_id, label, [CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * len(v) // {codes.PARTS} + 1:(p + 1) * len(v) // {codes.PARTS}] AS x FROM (SELECT *, unnest(range({codes.PARTS})) AS p FROM kept)
), books_0 AS MATERIALIZED (
    SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {codes.ENTRIES}
), {"".join(f"near_{r} AS MATERIALIZED ({_assigned(f'books_{r}')}), books_{r + 1} AS MATERIALIZED ({_moved(f'books_{r}', f'near_{r}')}), " for r in range(codes.ROUNDS))} last AS (
    {_assigned(f"books_{codes.ROUNDS}")}
), coded AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books_{codes.ROUNDS}) AS codebooks_sha256
FROM coded
"""

_STEP = "CASE " + " ".join(f"WHEN v >= {1 << (b - 1)} THEN {1 << (b - 5)}" for b in range(11, 5, -1)) + " ELSE 1 END"
_LEVEL = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.LEVELS.items()) + " END"
OP8 = f"""
WITH texts AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{WORD}')] AS lines FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM texts WHERE len(w) > 2
), again AS (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM again GROUP BY doc_id
), counts AS (
    SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
    FROM texts LEFT JOIN repeated USING (doc_id)
), measured AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), long AS (
    {" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{k}' AS rate, {a} AS counted, {b} AS among, CASE WHEN {b} = 0 THEN 0 ELSE {a} * 1000 // {b} END AS v FROM measured" for k, (a, b) in quality.RATES.items())}
), sketch AS (
    SELECT lang, source, rate, v - v % {_STEP} AS value, count(*) AS n FROM long WHERE NOT base_failed GROUP BY 1, 2, 3, 4
), of_all AS (
    SELECT rate, value, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rate) AS texts FROM sketch GROUP BY rate, value
), of_lang AS (
    SELECT lang, rate, value, sum(n) AS n FROM sketch GROUP BY lang, rate, value
), weighed AS (
    SELECT g.lang, g.source, g.rate, a.value, CAST(floor({quality.UNIT} * (coalesce(s.n, 0) + {quality.PRIOR} * ((coalesce(l.n, 0) + {quality.PRIOR} * a.n / a.texts) / (t.texts + {quality.PRIOR})))) AS BIGINT) AS weight
    FROM (SELECT DISTINCT lang, source, rate FROM sketch) g JOIN of_all a ON g.rate = a.rate JOIN (SELECT lang, rate, sum(n) AS texts FROM of_lang GROUP BY lang, rate) t ON t.rate = g.rate AND t.lang IS NOT DISTINCT FROM g.lang
    LEFT JOIN of_lang l ON l.rate = g.rate AND l.lang IS NOT DISTINCT FROM g.lang AND l.value = a.value LEFT JOIN sketch s ON s.rate = g.rate AND s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.value = a.value
), ranked AS (
    SELECT *, sum(weight) OVER (PARTITION BY lang, source, rate ORDER BY value) AS below, sum(weight) OVER (PARTITION BY lang, source, rate) AS total FROM weighed
), cutoffs AS (
    SELECT lang, source, rate, high + {quality.SPREAD} * (high - middle) AS cut
    FROM (SELECT lang, source, rate, min(CASE WHEN below * 100 >= total * 50 THEN value END) AS middle, min(CASE WHEN below * 100 >= total * {_LEVEL} THEN value END) AS high FROM ranked GROUP BY lang, source, rate)
), verdicts AS (
    SELECT long.doc_id, bool_and(counted <= (sqrt(among * (cut + 1) / 1000) + {quality.SPREAD} / 2) * (sqrt(among * (cut + 1) / 1000) + {quality.SPREAD} / 2)) AS fine
    FROM long LEFT JOIN cutoffs c ON long.rate = c.rate AND long.lang IS NOT DISTINCT FROM c.lang AND long.source IS NOT DISTINCT FROM c.source GROUP BY long.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, false) AS kept FROM measured JOIN verdicts USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op3_warc": OP3, "op5_near": OP5, "op7_topk": OP7, "op8_quality": OP8, "op12_codes": OP12}
