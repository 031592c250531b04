"""Queries and SQL of the llm operators: thin digests over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import decontaminate, htmlblocks, langid, linedup, mixing, quality, runs, secrets, sharding, simhash, sstable, trie, urlrules
from graphquarry.llm.common import deal


TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


OP1_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM k) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT j)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM r) GROUP BY rid),
b AS (SELECT w.rid, doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             array_to_string(ws, '') AS joined, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p ON p.rid = w.rid),
m AS (SELECT *, (length(joined) - length(regexp_replace(joined, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             length(joined) - length(regexp_replace(joined, '[A-Z]', '', 'g')) AS n_upper,
             length(joined) - length(regexp_replace(joined, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_odd FROM b),
f AS (SELECT *, ((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
             | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             | (CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END)
             | (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
             | (CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END)
             | (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
             | (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END)
             | (CASE WHEN 2 * n_odd > word_chars THEN 128 ELSE 0 END))::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM f
"""

def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.store(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.extract(pages(spark, sf_dir))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # OP5_SQL fixes rules of one token or two; the operator itself mines any length.
    return urlrules.judge(pages(spark, sf_dir), longest=2).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
                  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (SELECT *, translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(tail, '\?([^#]*)', 1) AS query FROM u),
s AS (SELECT v.* FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                              ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(verdict, rhost, rpath)),
f AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS stated
      FROM h JOIN s ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
t AS (SELECT rid, 'h' || (i - 1)::VARCHAR || '=' || x AS token
      FROM (SELECT rid, unnest(ls) AS x, generate_subscripts(ls, 1) AS i
            FROM (SELECT rid, list_filter(list_reverse(string_split(host, '.')), lambda y: y <> '') AS ls FROM h))
      UNION SELECT rid, 'p=' || regexp_replace(x, '[0-9]+', '0', 'g') FROM (SELECT rid, unnest(string_split(path, '/')) AS x FROM h) WHERE x <> ''
      UNION SELECT rid, 'q=' || x FROM (SELECT rid, unnest(string_split(query, '&')) AS x FROM h) WHERE x <> ''),
l AS (SELECT t.rid, token, stated FROM t JOIN f ON t.rid = f.rid),
n AS (SELECT count(DISTINCT rid) AS n FROM l),
i AS (SELECT rid, token AS a, token AS b FROM t UNION ALL SELECT x.rid, x.token, y.token FROM t x JOIN t y ON x.rid = y.rid AND x.token < y.token),
c AS (SELECT a, b, count(*) AS n_items, count(*) FILTER (stated = 'block') AS n_block, count(*) FILTER (stated = 'allow') AS n_allow
      FROM i JOIN f ON i.rid = f.rid GROUP BY a, b),
r AS (SELECT a, b, 'block' AS label, n_block AS hits, n_block::DOUBLE / n_items AS confidence FROM c
      UNION ALL SELECT a, b, 'allow', n_allow, n_allow::DOUBLE / n_items FROM c),
k AS (SELECT * FROM r WHERE hits >= ceil(0.002::DOUBLE * (SELECT n FROM n)) AND hits > 0 AND confidence >= 0.8),
m AS (SELECT i.rid, arg_max(label, (confidence, hits, label = 'block')) AS mined FROM i JOIN k USING (a, b) GROUP BY i.rid)
SELECT page_id, host, path, rule, coalesce(stated, mined, 'allow') AS verdict
FROM h LEFT JOIN f ON h.rid = f.rid LEFT JOIN m ON h.rid = m.rid
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
WITH x AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, h) - 1 AS copy FROM x),
d AS (SELECT *, md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || h || ':' || (copy // 10000)) AS k FROM y),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             3 * source_size AS lim, sum(source_size) OVER () AS total FROM s),
b AS (SELECT *, lim::DOUBLE / w AS ratio FROM a),
c AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b),
e AS (SELECT *, (total - before)::DOUBLE / rest AS lev FROM c),
t AS (SELECT source, source_size, least(lim::DOUBLE, w * (SELECT lev FROM e WHERE lev <= ratio ORDER BY ratio, lev LIMIT 1)) AS target FROM e),
r AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM r),
g AS (SELECT *, (epochs + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END)::BIGINT AS copies FROM f)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM g
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT item, least(10, len(ws)) AS n, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM iw),
ns AS (SELECT DISTINCT n FROM w),
dw AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, ns WHERE len(ws) >= n),
dk AS (SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win FROM dw),
m AS (SELECT rid, item, p, n FROM dk JOIN w USING (n, win)),
h AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS j FROM m) GROUP BY rid),
t AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN t ON d.rid = t.rid
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM t),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT rid) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key),
j AS (SELECT k.*, c.n IS NOT NULL AND c.n >= 3 AND doc_id IS DISTINCT FROM c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY rid
"""


#: CRC-32 as SQL has none: the table of the 256 remainders, and a fold over bytes given as a list.
CRC_TABLE_SQL = "(SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"


def crc_sql(text: str, table: str) -> str:
    fold = f"list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, y: xor({table}[(xor(c, y) & 255) + 1], c >> 8))"
    return f"xor({fold}, 4294967295)"


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS tab),
t AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(length(text) ORDER BY turn NULLS FIRST, k) AS ns FROM t GROUP BY conv_id),
h AS (SELECT own.*, ({crc_sql("conv_id::VARCHAR", "tab")} % 6)::INT AS h FROM own, crc),
r AS (SELECT h.conv_id, coalesce(b.ks[1:h], []) || h.ks[h + 1:] AS ks, coalesce(b.ns[1:h], []) || h.ns[h + 1:] AS ns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, array_to_string(ks[1:d], ',') AS path, list_transform(range(0, d + 1), lambda i: array_to_string(ks[1:i], ',')) AS above, ns[d] AS n, d = len(ks) AS ended
      FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM r)),
v AS (SELECT path, any_value(d) AS depth, any_value(above) AS above, coalesce(any_value(n), 0) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended) AS ends FROM p GROUP BY path),
c AS (SELECT above[depth] AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN c USING (path)),
s AS (SELECT up AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens FROM (SELECT *, unnest(above) AS up FROM w) GROUP BY up)
SELECT w.conv_id, w.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN v q ON w.depth > 0 AND q.path = w.above[w.depth]
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir))


def least_draw_sql(children: list[tuple[int, float]], path: str) -> str:
    draw = "-ln((('0x' || substr(md5(k || '{}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / {}::DOUBLE".format
    items = ", ".join(f"{{'d': {draw(f'{path}/{c}', w)}, 'c': {c}}}" for c, w in children)
    return f"list_sort([{items}])[1].c"


OP12_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS tab),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(doc_id::VARCHAR, 'null') AS k, {crc_sql("coalesce(text, '')", "tab")} AS text_crc32 FROM documents, crc),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM d),
r AS (SELECT *, md5(concat_ws(':', k, size, text_crc32, copy // 10000)) AS spread, {least_draw_sql([(0, 12.0), (1, 12.0)], "")} AS r, {least_draw_sql([(0, 12.0), (1, 12.0), (2, 1.0)], "")} AS g FROM n),
w AS (SELECT *, CASE r {" ".join(f"WHEN {r} THEN {least_draw_sql([(x, 4.0) for x in range(3)], f'/{r}')}" for r in range(2))} END AS w FROM r),
s AS (SELECT *, CASE 3 * r + w {" ".join(f"WHEN {3 * r + w} THEN {least_draw_sql([(12 * r + 4 * w + x, 1.0) for x in range(4)], f'/{r}/{w}')}" for r in range(2) for w in range(3))} END AS shard FROM w)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY spread, copy) - 1 AS slot,
       CASE WHEN g = 2 THEN 24 ELSE shard END::INT AS grown_shard FROM s
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.detect(documents(spark, sf_dir), planted=True, digests=True)
    return found.withColumnRenamed("runs", "runs_sha256").withColumnRenamed("collapsed", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_shards": op2_token_shards,
    "op3_language_id": op3_language_id,
    "op4_main_text": op4_main_text,
    "op5_url_rules": op5_url_rules,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op5_url_rules": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_sharding": OP12_SQL,
}
