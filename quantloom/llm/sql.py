"""DuckDB SQL of the results of operators that SQL can express; plain definitions, which share nothing with the operators."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


def url_filter(rules: list[tuple[str, str, str]], listed: tuple[str, ...]) -> str:
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for v, h, p in rules)
    on_list = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in listed)
    return f"""
    WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
    q AS (SELECT page_id, lower(regexp_extract(r, '^([^/?#]*)', 1)) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
    SELECT page_id, host, path, CASE {rule} END AS rule, ({on_list}) AS listed,
           CASE {verdict} WHEN {on_list} THEN 'block' ELSE 'allow' END AS verdict FROM q"""


def suffix_dedup(length: int) -> str:
    """Bytes as hexadecimal text, every string of `length` bytes by its place (cut from blocks, as substr counts from the start of its text), those met twice, and the runs they cover."""
    return f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    n AS (SELECT *, strlen(h) // 2 AS n_bytes FROM d),
    block AS (SELECT r, h, n_bytes, unnest(range(0, n_bytes - {length} + 1, 256)) AS b FROM n WHERE n_bytes >= {length}),
    part AS (SELECT r, b, substr(h, 2 * b + 1, 2 * ({length} + 255)) AS c, least(256, n_bytes - {length} + 1 - b) AS m FROM block),
    place AS (SELECT r, b, c, unnest(range(0, m)) AS j FROM part),
    win AS (SELECT r, b + j AS i, md5_number(substr(c, 2 * j + 1, 2 * {length})) AS k FROM place),
    twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
    marked AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM win SEMI JOIN twice USING (k)),
    run AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS s FROM marked),
    span AS (SELECT r, min(i) AS a, max(i) + {length} AS z FROM run GROUP BY r, s),
    cut AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM span),
    kept AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS head, max(z) AS tail FROM cut JOIN n USING (r) GROUP BY r)
    SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
    FROM n LEFT JOIN kept USING (r)"""


def substring_dedup(window: int) -> str:
    """Every window of so many words in order of documents and places; all but the first of each are covered."""
    return f"""
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    tok AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    win AS (SELECT r, i, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS s FROM tok
            WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
    marked AS (SELECT r, i, word, n = {window} AND row_number() OVER (PARTITION BY n, s ORDER BY r, i) > 1 AS later FROM win),
    cover AS (SELECT r, i, word, bool_or(later) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
    kept AS (SELECT r, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM cover GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)"""


def ngram_components(k: int, num: int, den: int) -> str:
    """Sets of shingles, pairs that share one, links by exact counts, and the smallest id that links reach."""
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
    tok AS (SELECT r, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    win AS (SELECT r, i, total, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS s FROM tok
            WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
    sets AS MATERIALIZED (SELECT DISTINCT r, n, s FROM win WHERE n = {k} OR (total < {k} AND i = 1)),
    size AS (SELECT r, count(*) AS m FROM sets GROUP BY r),
    pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.n = b.n AND a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
    link AS MATERIALIZED (SELECT x, y FROM pair JOIN size a ON a.r = x JOIN size b ON b.r = y WHERE {den} * c >= {num} * (a.m + b.m - c)),
    edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
    SELECT d.doc_id, coalesce(any_value(size.m), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
    FROM reach JOIN d ON d.r = reach.x JOIN d o ON o.r = reach.y LEFT JOIN size ON size.r = d.r GROUP BY d.r, d.doc_id"""
