"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from noteforge.llm import codes, leaks, lines, resample, topk, urls

ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({ASCII_LOWER.format(f'coalesce({text}, chr(32))')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def lines_sql(docs: str = "documents", extra: str = "") -> str:
    """CTEs that end in ``cleaned``: doc_id, text, n_lines, n_removed and the columns ``extra``."""
    value = "0"
    for back in range(lines.WINDOW - 1, -1, -1):
        value = f"(({value}) * {lines.FACTOR} + h[i + 1 - {back}]) % {(1 << 31) - 1}"
    return f"""
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls{extra} FROM {docs}),
lh AS (SELECT *, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM l),
le AS (SELECT *, list_filter(range(len(ls)), lambda i:
         i = len(ls) - 1 OR (i >= {lines.WINDOW - 1} AND {value} % {lines.DIVISOR} = 0)) AS e FROM lh),
lc AS (
  SELECT doc_id, k, e[k + 1] - s + 1 AS lines, array_to_string(ls[s + 1 : e[k + 1] + 1], chr(10)) AS body
  FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE e[k] + 1 END AS s FROM (SELECT *, unnest(range(len(e))) AS k FROM le))
),
lr AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS n, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS r
  FROM lc WHERE lines >= {lines.MIN_LINES}
),
lk AS (
  SELECT lc.*, coalesce(r > 1, FALSE) AS gone FROM lc LEFT JOIN (SELECT doc_id, k, r FROM lr WHERE n > 1) USING (doc_id, k)
),
kept AS (
  SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text,
         CAST(sum(lines) AS BIGINT) AS n_lines, CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed
  FROM lk GROUP BY doc_id
),
cleaned AS (
  SELECT l.doc_id, kept.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed{extra}
  FROM l LEFT JOIN kept USING (doc_id)
)"""


LINES = f"WITH {lines_sql()} SELECT doc_id, n_lines, n_removed, text FROM cleaned"

LEAKS = f"""
WITH items AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least({leaks.WIDTH}, len(w)) AS n,
         array_to_string(w[i : i + least({leaks.WIDTH}, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {leaks.WIDTH - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item_id FROM spots JOIN win USING (n, s)),
marks AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN marks USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {topk.SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {topk.EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {topk.K}
"""

_FITS = "((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
_RULES = sorted(urls.RULES, key=lambda r: (-len(r.name), -len(r.host)))


def _term_hits(terms: tuple[str, ...]) -> str:
    edge = "[^0-9a-z\\x{80}-\\x{10FFFF}]"
    return " + ".join(f"CAST(regexp_matches(low, '(?:^|{edge}){t}(?:$|{edge})') AS INTEGER)" for t in terms)


URLS = f"""
WITH p AS (
  SELECT page_id, {ASCII_LOWER.format("coalesce(url, '')")} AS low,
         {ASCII_LOWER.format(f"regexp_extract(coalesce(url, ''), '{urls.URL_PARTS}', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '{urls.URL_PARTS}', 2) AS path
  FROM pages
)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_FITS.format(r=r)} THEN '{r.name}'" for r in _RULES)} END AS rule,
       CASE {" ".join(f"WHEN {_FITS.format(r=r)} THEN '{r.verdict}'" for r in _RULES)}
            WHEN {_term_hits(urls.STRICT)} >= 1 OR {_term_hits(urls.SOFT)} >= {urls.SOFT_LIMIT} THEN 'block'
            ELSE 'allow' END AS verdict
FROM p
"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
),
d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '')
    AS payload_digest
  FROM p
),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM m
"""


def codes_sql(width: int = 4) -> str:
    """Product codes of vectors of ``codes.PARTS * width`` components."""

    def nearest(book: str) -> str:
        square = " + ".join(f"(pts.x[{j}] - {book}.x[{j}]) * (pts.x[{j}] - {book}.x[{j}])" for j in range(1, width + 1))
        return f"SELECT pts.vec_id, pts.p, any_value(pts.x) AS x, min(({square}) * 256 + e) AS m FROM pts JOIN {book} USING (p) GROUP BY pts.vec_id, pts.p"

    def moved(book: str, found: str) -> str:
        means = ", ".join(f"CAST(floor(sum(x[{j}]) / count(*)) AS BIGINT)" for j in range(1, width + 1))
        return f"""SELECT {book}.p, {book}.e, coalesce(n.x, {book}.x) AS x FROM {book}
  LEFT JOIN (SELECT p, m % 256 AS e, [{means}] AS x FROM {found} GROUP BY p, m % 256) n ON n.p = {book}.p AND n.e = {book}.e"""

    rounds = ",\n".join(
        f"a{i} AS ({nearest(f'c{i}')}),\nc{i + 1} AS ({moved(f'c{i}', f'a{i}')})"
        for i in range(codes.ROUNDS)
    )
    last = f"c{codes.ROUNDS}"
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pts AS (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS x FROM kept, range({codes.PARTS}) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {codes.ENTRIES}),
c0 AS (SELECT p, e, x FROM pts JOIN firsts USING (vec_id)),
{rounds},
done AS ({nearest(last)}),
coded AS (
  SELECT vec_id, string_agg(lower(lpad(to_hex(m % 256), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
  FROM done GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM {last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


CODES = codes_sql()

_B, _ONES = resample.BUCKETS, (1 << 32) - 1

RESAMPLE = f"""
WITH tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
),
dw AS (SELECT doc_id, unnest({_words('text')}) AS w FROM documents),
bw AS (SELECT unnest({_words('text')}) AS w FROM benchmark),
seen AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend({_ONES}, list_transform(range(length(x) // 2),
           lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), {_ONES}) % {_B} AS k
  FROM (SELECT w, hex(encode(w)) AS x FROM seen), tab
),
gain AS (
  SELECT k, CAST(floor(1000 * ln(
    CAST(coalesce(bn.n, 0) + 1 AS DOUBLE) * (sum(coalesce(dn.n, 0)) OVER () + {_B})
    / (CAST(coalesce(dn.n, 0) + 1 AS DOUBLE) * (sum(coalesce(bn.n, 0)) OVER () + {_B})))) AS BIGINT) AS g
  FROM (SELECT k, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY k) dn
  FULL JOIN (SELECT k, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY k) bn USING (k)
),
weighed AS (
  SELECT doc_id, count(k) AS n_features, coalesce(CAST(floor(CAST(sum(g) AS DOUBLE) / count(k)) AS BIGINT), 0) AS weight
  FROM documents LEFT JOIN dw USING (doc_id) LEFT JOIN bucket USING (w) LEFT JOIN gain USING (k) GROUP BY doc_id
),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5)
         / 4294967296))) AS BIGINT) AS score
  FROM weighed
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
           FROM scored WHERE n_features >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {resample.PERCENT} * n // 100 THEN r END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
