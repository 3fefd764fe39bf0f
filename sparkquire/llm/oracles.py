"""DuckDB SQL for the queries whose rows SQL can give, on the same tables.

Those of op1, op4, op6 and op10 hold a trained model or a tokenizer, that of op13 random walks; tests check them by held-out
accuracy or against the tokenizer library instead.
"""

from __future__ import annotations

from .queries import SHARDS, URL_RULES

_DRAWN = "(('0x' || substr(md5('shard:' || {i} || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


def _shard(n: int) -> str:
    scores = [f"{{'score': -1.0 / ln({_DRAWN.format(i=i)}), 'shard': {i}}}" for i in range(n)]
    return f"list_max([{', '.join(scores)}]).shard"


# CRC-32 by its table, a byte at a time: DuckDB has no function for it.
_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])))"""
_CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS crc)"

OP2 = f"""WITH {_CRC_TABLE}, r AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, xor(4294967295::BIGINT, {_CRC})::BIGINT AS text_crc32, {_shard(SHARDS)}::INTEGER AS shard, {_shard(SHARDS + 1)}::INTEGER AS grown_shard FROM documents, t),
h AS (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || text_crc32) AS h FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM h"""

_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
# pages of the test tables name no aliases, so a page without a rule is allowed
OP3 = f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages), r(action, h, q) AS (VALUES {_RULES}),
f AS (SELECT page_id, action, h || q AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND k = 1"""

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS z FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.z * b.z) >= 0.95 WHERE a.z > 0 AND b.z > 0),
reach AS (SELECT x, x AS y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1), k AS (SELECT x, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id"""

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS7 = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = f"""WITH i AS (SELECT item_id, {_WORDS7} AS w FROM benchmark), win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, j, j + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS j FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS7} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, j, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, j, spots.n, item_id FROM spots JOIN win ON spots.n = win.n AND spots.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(j, j + n - 1)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_WORDS8 = "regexp_extract_all(" + _LOWER.format(t="coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, j, j + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)), l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT x, x AS y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x), m AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""

# base32 of a SHA-1: eight groups of five bits in each ten hex digits
OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS s, min(page_id) OVER (PARTITION BY body) AS least FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM h"""


OP11 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format(t="coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM d),
f AS MATERIALIZED (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, count(*)::HUGEINT AS f FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, range(1, 4) r(k) WHERE len(w) >= k) GROUP BY ALL HAVING f >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.g, a, j, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(w[2:], ' ') AS g, f FROM (SELECT lang, string_split(g, ' ') AS w, f FROM f WHERE k = 3) UNION ALL SELECT lang, array_to_string(w[:2], ' '), f FROM (SELECT lang, string_split(g, ' ') AS w, f FROM f WHERE k = 3)),
m AS (SELECT lang, g, max(f) AS f FROM o GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE coalesce(100 * m.f < 50 * a, true))
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= 2000"""


def _op12(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Plain Lloyd rounds in integers, one chain of tables a round."""
    distances = "list_transform(g, lambda y: list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT)"
    out = f"""WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS x FROM e, range({parts}) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries}))"""
    for r in range(rounds + 1):
        out += f""",
g{r} AS MATERIALIZED (SELECT p, list(c ORDER BY k) AS g FROM c{r} GROUP BY p),
d{r} AS MATERIALIZED (SELECT vec_id, p, x, {distances} AS d FROM v JOIN g{r} USING (p)),
a{r} AS MATERIALIZED (SELECT vec_id, p, x, list_position(d, list_min(d)) - 1 AS k, list_min(d) AS least FROM d{r})"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT p, k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(x)) FROM v) + 1) q(i) GROUP BY ALL),
m{r} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))"""
    return out + f""",
t AS (SELECT vec_id, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, sum(least)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
b AS (SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, k) AS b FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256(b) AS codebooks_sha256 FROM t JOIN e USING (vec_id), b"""


OP12 = _op12()


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2, "op3_url_filter": OP3, "op5_embedding_dedup": OP5, "op7_decontamination": OP7, "op8_jaccard_join": OP8, "op9_warc": OP9, "op11_collocations": OP11, "op12_vector_codes": OP12}
