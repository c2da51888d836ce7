"""SQL checks of the registered queries that SQL can express."""

from __future__ import annotations

from readalike.llm.mixing import CAP, SEED, SHARE, WEIGHTS

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_WEIGHT = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))

MIX = f"""
    WITH sized AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size FROM documents),
    total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT *, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}
                       {_WEIGHT} END AS DOUBLE) AS weight FROM total),
    levels AS (
        SELECT *, source_size * CAST({CAP} AS DOUBLE) / weight AS quotient,
               (CAST({SHARE} AS DOUBLE) * sum(source_size) OVER ()
                - coalesce(CAST({CAP} AS DOUBLE) * sum(source_size) OVER earlier, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
        FROM weighed WINDOW earlier AS (ORDER BY source_size * CAST({CAP} AS DOUBLE) / weight, encode(source) NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    final AS (SELECT arg_min(level, quotient) AS level FROM levels WHERE level < quotient),
    targets AS (
        SELECT l.source, source_size,
               least(source_size * CAST({CAP} AS DOUBLE), coalesce(weight * f.level, source_size * CAST({CAP} AS DOUBLE))) AS target
        FROM levels l CROSS JOIN final f),
    rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
    SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
               CAST('0x' || substr(md5('{SEED} ' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
               / CAST({1 << 52} AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Five hexadecimal digits are four letters.
_BASE32 = " || ".join(
    f"substr('{_LETTERS}', (CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {shift} & 31) + 1, 1)"
    for k in range(8) for shift in (15, 10, 5, 0))

RECORDS = f"""
    WITH hashed AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    latest AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM hashed)
    SELECT page_id, octet_length(payload) AS payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < last THEN last END AS refers_to
    FROM latest"""

LINKED = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
    FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id"""

ORACLE: dict[str, str] = {"op5_mix_sources": MIX, "op10_warc_zip": RECORDS, "op11_ngram_join": LINKED}
