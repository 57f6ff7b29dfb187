"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftfold.config import BatchOptions
from siftfold.functions import exprs, kernels
from siftfold.operators import grouping, similarity
from siftfold.plans import pipeline, report
from siftfold.sources import tables
from siftfold.storage import scratch
from siftfold.streaming.pipeline import groups_of_stream

MIN_SIZE = 1024
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.corpus_of_documents(_read(spark, d, "documents"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.corpus_of_pages(_read(spark, d, "pages"))


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return tables.corpus_of_benchmark(_read(spark, d, "benchmark"))


def _big(spark: SparkSession, d: str) -> DataFrame:
    return grouping.duplicates_direct(grouping.at_least(_docs(spark, d), MIN_SIZE))


_D = "d AS (SELECT doc_id, '/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size, coalesce(text, '') AS t FROM documents)"
_P = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '/') AS path, strlen(coalesce(html, ''))::BIGINT AS size FROM pages)"
_M = f"""{_D}, h AS (SELECT *, sha256(t) AS checksum, count(*) OVER (PARTITION BY size, sha256(t)) AS n FROM d WHERE size >= {MIN_SIZE}),
m AS (SELECT *, row_number() OVER (PARTITION BY size, checksum ORDER BY doc_id DESC, path) AS rank, dense_rank() OVER (ORDER BY size, checksum) AS group_id FROM h WHERE n > 1)"""


@query(f"WITH {_D} SELECT size, count(*)::BIGINT AS n, sum(size)::BIGINT AS total_size FROM d GROUP BY size HAVING count(*) > 1")
def q_size_groups(spark, d):
    return grouping.groups_by(_docs(spark, d), "size")


@query(f"WITH {_D} SELECT doc_id, size FROM d WHERE size IN (SELECT size FROM d GROUP BY size HAVING count(*) = 1)")
def q_size_singletons(spark, d):
    return grouping.unique_rows(_docs(spark, d), "size").select(F.col("id").alias("doc_id"), "size")


@query(f"WITH {_M} SELECT doc_id, size, checksum FROM m")
def q_exact_duplicates(spark, d):
    return _big(spark, d).select(F.col("id").alias("doc_id"), "size", "checksum")


@query(f"WITH {_M} SELECT doc_id, size, checksum FROM m")
def q_staged_duplicates(spark, d):
    return grouping.duplicates_staged(grouping.at_least(_docs(spark, d), MIN_SIZE)).select(F.col("id").alias("doc_id"), "size", "checksum")


@query(f"WITH {_M} SELECT doc_id, rank::BIGINT AS rank, rank = 1 AS is_primary FROM m")
def q_primary_selection(spark, d):
    return grouping.with_primary(_big(spark, d), "size", "checksum").select(F.col("id").alias("doc_id"), "rank", "is_primary")


@query(f"""WITH {_M} SELECT group_id::BIGINT AS group_id, path, size, rank = 1 AS is_primary, CASE WHEN rank = 1 THEN 0 ELSE size END::BIGINT AS potential_savings FROM m""")
def q_report_members(spark, d):
    return report.report_members(_big(spark, d)).select("group_id", "path", "size", "is_primary", "potential_savings")


@query(f"""WITH {_M} SELECT group_id::BIGINT AS id, 'group_' || group_id AS identifier, 100.0::DOUBLE AS similarity, sum(size)::BIGINT AS total_size, (sum(size) - max(size))::BIGINT AS potential_savings FROM m GROUP BY group_id""")
def q_report_groups(spark, d):
    return report.report_groups(_big(spark, d)).select("id", "identifier", "similarity", "total_size", "potential_savings")


@query(f"""WITH {_M}, g AS (SELECT count(*) AS n, sum(size) AS s, max(size) AS one FROM m GROUP BY group_id)
SELECT count(*)::BIGINT AS duplicate_groups, sum(n)::BIGINT AS duplicate_files, sum(s)::BIGINT AS total_size, sum(s - one)::BIGINT AS potential_savings,
(SELECT count(*) FROM d)::BIGINT AS total_files, (SELECT sum(size) FROM d)::BIGINT AS scanned_bytes, round(sum(s - one) * 100.0::DOUBLE / sum(s), 6) AS savings_percent FROM g""")
def q_report_stats(spark, d):
    stats = report.report_stats(_big(spark, d), _docs(spark, d))
    return stats.select("duplicate_groups", "duplicate_files", "total_size", "potential_savings", "total_files", "scanned_bytes", F.round("savings_percent", 6).alias("savings_percent"))


@query(f"""WITH {_M} SELECT group_id::BIGINT AS group_id, rank::BIGINT AS rank, group_id || ',100,' || path || ',' || size || ',"' || strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%d %H:%M:%S') || '","unknown",' || (rank = 1)::VARCHAR || ',' || CASE WHEN rank = 1 THEN 0 ELSE size END AS line FROM m""")
def q_csv_lines(spark, d):
    return report.csv_lines(report.report_members(_big(spark, d)))


_STAMP = "strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%d %H:%M:%S')"


@query(f"""WITH {_M} SELECT group_id::BIGINT AS group_id, '{{"id":' || group_id || ',"identifier":"group_' || group_id || '","similarity":100.0,"total_size":' || sum(size) || ',"potential_savings":' || (sum(size) - max(size)) || ',"files":[' ||
string_agg('{{"path":"' || path || '","size":' || size || ',"modified":"' || {_STAMP} || '","file_type":"unknown","is_primary":' || (rank = 1)::VARCHAR || '}}', ',' ORDER BY rank) || ']}}' AS json FROM m GROUP BY group_id""")
def q_json_groups(spark, d):
    return report.json_groups(report.report_members(_big(spark, d)))


_UNITS = "CASE WHEN {0} >= 1048576 THEN printf('%.1f MiB', round({0} / 1048576.0::DOUBLE, 1)) WHEN {0} >= 1024 THEN printf('%.1f KiB', round({0} / 1024.0::DOUBLE, 1)) ELSE {0} || ' B' END"


@query(f"""WITH {_M} SELECT group_id::BIGINT AS group_id, rank::BIGINT AS rank, '  [' || CASE WHEN rank = 1 THEN 'keep  ' ELSE 'remove' END || '] ' || path || ' (' || {_UNITS.format('size')} || ', ' || {_STAMP} || ')' AS line FROM m""")
def q_text_lines(spark, d):
    return report.text_lines(report.report_members(_big(spark, d)))


@query(f"""WITH {_M}, g AS (SELECT group_id, count(*) AS n, sum(size)::BIGINT AS s, max(size) AS one FROM m GROUP BY group_id)
SELECT group_id::BIGINT AS group_id, 'Group ' || group_id || ': ' || n || ' files, ' || {_UNITS.format('s')} || ', ' || {_UNITS.format('(s - one)')} || ' could be saved' AS line FROM g""")
def q_text_headers(spark, d):
    return report.text_headers(report.report_members(_big(spark, d)))


@query(f"""WITH {_M} SELECT path, CASE WHEN rank = 1 THEN 'keep' ELSE 'remove' END AS action FROM m""")
def q_action_plan(spark, d):
    return report.action_plan(report.report_members(_big(spark, d))).select("path", "action")


@query(f"WITH {_D} SELECT doc_id, size FROM d WHERE size >= {MIN_SIZE}")
def q_min_size_filter(spark, d):
    return grouping.at_least(_docs(spark, d), MIN_SIZE).select(F.col("id").alias("doc_id"), "size")


@query(f"WITH {_P} SELECT page_id, lower(nullif(regexp_extract(string_split(path, '/')[-1], '[^/]\\.([^./]+)$', 1), '')) AS extension FROM p")
def q_extension(spark, d):
    return _pages(spark, d).select(F.col("id").alias("page_id"), "extension")


#: Paths of all kinds for documents, by their ids; the same expression in both dialects.
_PATHS = "concat('/', CASE WHEN doc_id % 7 = 0 THEN '.cache/' ELSE 'data/' END, lang, '/', repeat('d/', cast(doc_id % 4 AS int)), CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END, 'f', doc_id, CASE cast(doc_id % 5 AS int) WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.html' WHEN 3 THEN '' ELSE '.tar.GZ' END)"
_F = f"f AS (SELECT doc_id, {_PATHS} AS path FROM documents)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return tables.as_corpus(docs, F.expr(_PATHS), F.col("text"), F.timestamp_seconds("doc_id"), F.col("doc_id"))


@query(f"WITH {_F} SELECT doc_id FROM f WHERE regexp_matches(lower(path), '\\.(txt|md|gz)$')")
def q_extension_filter(spark, d):
    return grouping.by_extension(_files(spark, d), ["TXT", "md", ".gz"]).select(F.col("id").alias("doc_id"))


@query(f"WITH {_F} SELECT doc_id, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::BIGINT AS depth FROM f WHERE len(list_filter(string_split(path, '/'), lambda s: s <> '')) <= 4")
def q_depth_filter(spark, d):
    return grouping.not_deeper(_files(spark, d), 4).select(F.col("id").alias("doc_id"), F.col("depth").cast("long").alias("depth"))


@query(f"WITH {_F} SELECT doc_id FROM f WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def q_hidden_filter(spark, d):
    return grouping.visible(_files(spark, d)).select(F.col("id").alias("doc_id"))


@query(f"WITH {_F} SELECT doc_id FROM f WHERE doc_id % 7 <> 0 AND lang <> 'fr'".replace("FROM f", "FROM documents"))
def q_directory_filter(spark, d):
    return grouping.outside(_files(spark, d), [".cache", "fr"]).select(F.col("id").alias("doc_id"))


_PROBE = "left(hex(encode(t)), 1024)"
_PRINT = "len(regexp_extract_all(regexp_replace(left(hex(encode(t)), 1024), '(..)', '\\1 ', 'g'), '(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0C|0D) '))"
_MIME = "CASE WHEN strlen(t) < 4 THEN NULL " + " ".join(f"WHEN starts_with({_PROBE}, '{h}') THEN '{m}'" for h, m in exprs.MAGIC) + f" WHEN {_PRINT} * 2 = length({_PROBE}) THEN 'text/plain' END"


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, " + _MIME + " AS kind FROM d) SELECT doc_id FROM k WHERE kind = 'text/plain'")
def q_type_filter(spark, d):
    typed = _docs(spark, d).withColumn("file_type", exprs.mime_type(exprs.first_bytes(F.col("content"), 4096)))
    return grouping.by_type(typed, ["text", "image/png"], ["image"]).select(F.col("id").alias("doc_id"))


_FLAGS = (
    f"(length({_PROBE}) // 2 - {_PRINT} > (length({_PROBE}) // 2) // 4)", f"({_PRINT} > (length({_PROBE}) // 2) * 3 // 4)",
    "(" + " OR ".join(f"starts_with({_PROBE}, '{h}')" for h in exprs.COMPRESSED) + ")", "(" + " OR ".join(f"starts_with({_PROBE}, '{h}')" for h in exprs.EXECUTABLE) + ")",
)


@query(f"WITH {_D} SELECT doc_id, {_MIME} AS mime_type FROM d")
def q_mime_type(spark, d):
    return _docs(spark, d).select(F.col("id").alias("doc_id"), exprs.mime_type(exprs.first_bytes(F.col("content"), 4096)).alias("mime_type"))


@query(f"WITH {_D} SELECT doc_id, {_FLAGS[0]} AS is_binary, {_FLAGS[1]} AS is_text, {_FLAGS[2]} AS is_compressed, {_FLAGS[3]} AS is_executable FROM d")
def q_structure_flags(spark, d):
    return _docs(spark, d).select(F.col("id").alias("doc_id"), exprs.structure_flags(exprs.first_bytes(F.col("content"), 4096)).alias("s")).select("doc_id", "s.*")


@query(f"""WITH {_D}, s AS (SELECT left(hex(encode(t)), 8192) AS h, CASE WHEN size > 1024 THEN right(hex(encode(t)), 2048) END AS f FROM d)
SELECT md5(h || ':' || coalesce(f, '-')) AS sample, count(*)::BIGINT AS n FROM s GROUP BY h, f HAVING count(*) > 1""")
def q_header_footer_groups(spark, d):
    s = _docs(spark, d).select(grouping.content_sample().alias("s"))
    g = s.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.select(F.md5(F.concat_ws(":", F.hex("s.header"), F.coalesce(F.hex("s.footer"), F.lit("-"))).cast("binary")).alias("sample"), "n")


def _checksum_sql(data: str) -> str:
    return f"""WITH RECURSIVE {_D}, c(k, power, times) AS (SELECT 0, 1::HUGEINT, 1::HUGEINT UNION ALL
SELECT k + 1, (power * 31) % 18446744073709551616, (times + (power * 31) % 18446744073709551616) % 18446744073709551616 FROM c WHERE k < 24576),
x AS (SELECT doc_id, size, hex(encode(t)) AS h FROM d), y AS (SELECT doc_id, {data} AS s FROM x),
b AS (SELECT doc_id, len(l) AS n, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(s, '..') AS l FROM y)),
r AS (SELECT doc_id, (sum(('0x' || v)::HUGEINT * times) % 18446744073709551616)::VARCHAR AS checksum FROM b JOIN c ON k = n - i GROUP BY doc_id)
SELECT doc_id, coalesce(checksum, '0') AS sample_checksum, (length(s) // 2)::BIGINT AS sample_size FROM y LEFT JOIN r USING (doc_id)"""


@query(_checksum_sql("CASE WHEN size <= 3 * least(size, 8192) THEN left(h, 2 * least(size, 8192)::INT) ELSE left(h, 16384) || substr(h, 2 * (size // 2 - 4096) + 1, 16384) || right(h, 16384) END"))
def q_rolling_checksum(spark, d):
    q = _docs(spark, d).select(F.col("id").alias("doc_id"), kernels.quick_check_udf(8192)(F.col("content")).alias("q"))
    return q.select("doc_id", "q.sample_checksum", "q.sample_size")


_BYTES = "b AS (SELECT doc_id, unnest(regexp_extract_all(left(hex(encode(t)), 131072), '..')) AS v FROM d)"


@query(f"""WITH {_D}, {_BYTES}, c AS (SELECT doc_id, v, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c),
e AS (SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY doc_id) SELECT doc_id, coalesce(entropy, 0) + 0.0 AS entropy FROM d LEFT JOIN e USING (doc_id)""")
def q_entropy(spark, d):
    prefix = exprs.first_bytes(F.col("content"), kernels.PREFIX)
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.round(kernels.entropy_udf(prefix), 6).alias("entropy"))


@query(f"WITH {_D}, b AS (SELECT unnest(regexp_extract_all(hex(encode(t)), '..')) AS v FROM d) SELECT ('0x' || v)::BIGINT AS byte, count(*)::BIGINT AS n FROM b GROUP BY ALL")
def q_byte_histogram(spark, d):
    counts = _docs(spark, d).select(F.posexplode(kernels.byte_counts_udf(F.col("content"))).alias("byte", "n")).where("n > 0")
    return counts.groupBy(F.col("byte").cast("long").alias("byte")).agg(F.sum("n").alias("n"))


def _simhash_sql(relation: str) -> str:
    bits = " + ".join(f"CASE WHEN 2 * sum((x >> {k}) & 1) > count(*) THEN {1 << k} ELSE 0 END" for k in range(23))
    return f"""b AS (SELECT id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT id, list_transform(regexp_extract_all(left(hex(encode(t)), 131072), '..'), lambda z: ('0x' || z)::BIGINT) AS l FROM {relation})),
g AS (SELECT id, v * 29791 + lead(v, 1) OVER w * 961 + lead(v, 2) OVER w * 31 + lead(v, 3) OVER w AS x FROM b WINDOW w AS (PARTITION BY id ORDER BY i)),
s AS (SELECT id, ({bits})::BIGINT AS simhash FROM g WHERE x IS NOT NULL GROUP BY id)"""


@query(f"WITH {_D}, i AS (SELECT doc_id AS id, t FROM d), {_simhash_sql('i')} SELECT i.id AS doc_id, coalesce(simhash, 0)::BIGINT AS simhash FROM i LEFT JOIN s USING (id)")
def q_simhash_shingle(spark, d):
    return _docs(spark, d).select(F.col("id").alias("doc_id"), kernels.shingle_simhash_udf(exprs.first_bytes(F.col("content"), kernels.PREFIX)).alias("simhash"))


@query(f"WITH i AS (SELECT item_id AS id, text AS t FROM benchmark), {_simhash_sql('i')} SELECT a.id AS id_a, b.id AS id_b, round((64 - bit_count(xor(a.simhash, b.simhash))) / 64.0::DOUBLE, 6) AS similarity FROM s a JOIN s b ON a.id < b.id")
def q_hamming_pairs(spark, d):
    s = _bench(spark, d).select("id", kernels.shingle_simhash_udf(F.col("content")).alias("simhash"))
    a, b = s.select(F.col("id").alias("id_a"), F.col("simhash").alias("a")), s.select(F.col("id").alias("id_b"), F.col("simhash").alias("b"))
    return a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.round(exprs.hamming_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {_D} SELECT doc_id, upper(left(sha256(unhex(left(hex(encode(t)), 131072))), 32)) AS fingerprint FROM d")
def q_fingerprint16(spark, d):
    prefix = exprs.first_bytes(F.col("content"), kernels.PREFIX)
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.upper(F.substring(F.sha2(prefix, 256), 1, 32)).alias("fingerprint"))


@query(f"WITH {_D}, n AS (SELECT doc_id, size, least(1000, greatest(10, size // 4096)) AS n FROM d WHERE size > 0) SELECT doc_id, unnest(range(n))::BIGINT AS block, (unnest(range(n)) * size // n)::BIGINT AS offset FROM n")
def q_block_sample_plan(spark, d):
    rows = _docs(spark, d).where("size > 0").select(F.col("id").alias("doc_id"), "size", F.expr("least(1000, greatest(10, size div 4096))").alias("n"))
    return rows.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("block")).select("doc_id", "block", F.expr("block * size div n").alias("offset"))


_FREQ = """i AS (SELECT item_id AS id, text AS t FROM benchmark), b AS (SELECT id, unnest(regexp_extract_all(hex(encode(t)), '..')) AS v FROM i),
c AS (SELECT id, v, count(*)::DOUBLE AS n FROM b GROUP BY ALL)"""


@query(f"""WITH {_FREQ}, q AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id)
SELECT x.id AS id_a, y.id AS id_b, round(sum(x.n * y.n) / (any_value(p.norm) * any_value(r.norm)) * 100, 6) AS similarity FROM c x JOIN c y ON x.v = y.v AND x.id < y.id JOIN q p ON p.id = x.id JOIN q r ON r.id = y.id GROUP BY x.id, y.id""")
def q_cosine_pairs(spark, d):
    f = _bench(spark, d).select("id", F.transform(kernels.byte_counts_udf(F.col("content")), lambda x: x.cast("double")).alias("f"))
    a, b = f.select(F.col("id").alias("id_a"), F.col("f").alias("a")), f.select(F.col("id").alias("id_b"), F.col("f").alias("b"))
    return a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.round(exprs.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""WITH {_FREQ}, p AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM c), e AS (SELECT id, -sum(p * log2(p)) AS e FROM p GROUP BY id)
SELECT a.id AS id_a, b.id AS id_b, round((8 - abs(a.e - b.e)) / 8 * 100, 6) AS similarity FROM e a JOIN e b ON a.id < b.id""")
def q_entropy_similarity(spark, d):
    e = _bench(spark, d).select("id", exprs.entropy_of(F.transform(kernels.byte_counts_udf(F.col("content")), lambda x: x / F.octet_length("content"))).alias("e"))
    a, b = e.select(F.col("id").alias("id_a"), F.col("e").alias("a")), e.select(F.col("id").alias("id_b"), F.col("e").alias("b"))
    return a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.round(exprs.entropy_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


# Fingerprints of the sampled blocks: the running state, its votes on 64 bits, byte frequencies and entropy.
_PRINTS = """i AS (SELECT item_id AS id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS size FROM benchmark),
n AS (SELECT id, h, size, least(1000, greatest(10, size // 4096)) AS n FROM i),
k AS (SELECT id, h, size, n, unnest(range(n)) AS k FROM n),
x AS (SELECT id, string_agg(substr(h, 2 * (k * size // n)::BIGINT + 1, 8192), '' ORDER BY k) AS s FROM k GROUP BY id),
y AS (SELECT id, list_transform(regexp_extract_all(s, '..'), lambda z: ('0x' || z)::HUGEINT) AS l FROM x),
r(id, pos, state) AS (SELECT id, 0, 0::HUGEINT FROM y UNION ALL SELECT r.id, pos + 1, (state * 31 + l[pos + 1]) % 18446744073709551616 FROM r JOIN y USING (id) WHERE pos < len(l)),
v AS (SELECT id, state FROM r WHERE pos > 0),
u AS (SELECT id, unnest(range(64)) AS bit FROM y),
w AS (SELECT u.id, bit, 2 * sum((state // power) % 2) > count(*) AS is_set FROM u JOIN v USING (id) JOIN (SELECT k::INT AS bit, list_reduce(list_prepend(1::HUGEINT, list_transform(range(k), lambda q: 2::HUGEINT)), lambda p, q: p * q) AS power FROM range(64) t(k)) USING (bit) GROUP BY u.id, bit),
g AS (SELECT id, list(is_set ORDER BY bit) AS bits FROM w GROUP BY id),
c AS (SELECT id, z AS v, count(*)::DOUBLE AS n FROM (SELECT id, unnest(l) AS z FROM y) GROUP BY ALL),
q AS (SELECT id, sqrt(sum(n * n)) AS norm, sum(n) AS total FROM c GROUP BY id),
e AS (SELECT id, -sum(n / total * log2(n / total)) AS entropy FROM c JOIN q USING (id) GROUP BY id),
dots AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.v = b.v AND a.id < b.id GROUP BY ALL),
sims AS (SELECT a.id AS id_a, b.id AS id_b, 40 * (64 - len(list_filter(list_zip(a.bits, b.bits), lambda t: t[1] <> t[2]))) / 64.0::DOUBLE + 40 * coalesce(dot, 0) / (p.norm * o.norm) + 20 * (8 - abs(f.entropy - j.entropy)) / 8 AS similarity
FROM g a JOIN g b ON a.id < b.id JOIN q p ON p.id = a.id JOIN q o ON o.id = b.id JOIN e f ON f.id = a.id JOIN e j ON j.id = b.id LEFT JOIN dots ON dots.id_a = a.id AND dots.id_b = b.id)"""
#: As a share of pairs, so that some rows lead and some do not.
_CLOSE = 80.0
_LEADERS = f"""{_PRINTS}, earlier AS (SELECT i.id, row_number() OVER (ORDER BY i.id) AS pos, coalesce(list(id_a) FILTER (id_a IS NOT NULL), []) AS near FROM i LEFT JOIN sims ON id_b = i.id AND similarity >= {_CLOSE} GROUP BY i.id),
steps(pos, leaders, id, leader) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT t.pos, CASE WHEN len(list_intersect(leaders, near)) = 0 THEN list_append(leaders, t.id) ELSE leaders END, t.id, coalesce(list_min(list_intersect(leaders, near)), t.id) FROM steps JOIN earlier t ON t.pos = steps.pos + 1),
lead AS (SELECT id, leader, count(*) OVER (PARTITION BY leader) AS members FROM steps WHERE id IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_PRINTS} SELECT id, bits, round(entropy, 6) AS entropy FROM (SELECT id, list_reduce(list_transform(bits, lambda b: CASE WHEN b THEN '1' ELSE '0' END), lambda p, b: p || b) AS bits FROM g) JOIN e USING (id)""")
def q_block_fingerprints(spark, d):
    prints = similarity.fingerprints(_bench(spark, d))
    return prints.select("id", F.reverse(F.lpad(F.bin("simhash"), 64, "0")).alias("bits"), F.round("entropy", 6).alias("entropy"))


@query(f"WITH RECURSIVE {_PRINTS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM sims")
def q_combined_similarity(spark, d):
    """Of all pairs of benchmark items."""
    return similarity.similar_pairs(similarity.fingerprints(_bench(spark, d)), 0.0, 16).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH RECURSIVE {_PRINTS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM sims WHERE similarity >= 85")
def q_similar_pairs(spark, d):
    return similarity.similar_pairs(similarity.fingerprints(_bench(spark, d))).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH RECURSIVE {_LEADERS} SELECT id, leader FROM lead")
def q_leader_clusters(spark, d):
    prints = similarity.fingerprints(_bench(spark, d))
    return similarity.leader_clusters(prints.select("id"), similarity.similar_pairs(prints, _CLOSE))


@query(f"""WITH {_D}, s AS (SELECT size, count(*)::BIGINT AS n FROM d GROUP BY size HAVING count(*) > 1),
h AS (SELECT doc_id, size, sha256(t) AS c FROM d), p AS (SELECT a.size, avg((1 + (a.c = b.c)::INT) / 2.0::DOUBLE * 100) AS similarity FROM h a JOIN h b ON a.size = b.size AND a.doc_id < b.doc_id GROUP BY a.size)
SELECT size, n, round(similarity, 6) AS similarity FROM s JOIN p USING (size)""")
def q_group_similarity(spark, d):
    rows = grouping.members_of_groups(grouping.with_checksum(_docs(spark, d)).select("id", "size", "checksum"), "size")
    return similarity.group_similarity(rows, "size").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_D}, {_P} SELECT root, count(*)::BIGINT AS n, sum(size)::BIGINT AS total_size FROM (SELECT 'documents' AS root, size FROM d UNION ALL SELECT 'pages', size FROM p UNION ALL SELECT 'benchmark', strlen(text)::BIGINT FROM benchmark) GROUP BY root")
def q_roots_union(spark, d):
    named = [f(spark, d).select(F.lit(n).alias("root"), "size") for n, f in (("documents", _docs), ("pages", _pages), ("benchmark", _bench))]
    return tables.union_roots(*named).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"))


@query(f"WITH {_D} SELECT doc_id, size AS group_key, count(*) OVER (PARTITION BY size) = 1 AS single FROM d")
def q_metadata_stage(spark, d):
    out = pipeline.MetadataStage().apply(_docs(spark, d).select("id", "size"))
    n = out.groupBy("group_key").agg((F.count(F.lit(1)) == 1).alias("single"))
    return out.join(n, "group_key").select(F.col("id").alias("doc_id"), F.expr("cast(substring(group_key, 6) as bigint)").alias("group_key"), "single")


@query(f"""WITH {_D}, s AS (SELECT doc_id, count(*) OVER (PARTITION BY left(hex(encode(t)), 8192), CASE WHEN size > 1024 THEN right(hex(encode(t)), 2048) END) AS n FROM d)
SELECT doc_id, 'continue' AS disposition FROM s WHERE n > 1""")
def q_quick_check_stage(spark, d):
    return pipeline.QuickCheckStage().apply(_docs(spark, d)).select(F.col("id").alias("doc_id"), "disposition")


@query(f"WITH {_D} SELECT doc_id, 'hash:' || size || ':' || sha256(t) AS group_key FROM d WHERE (size, sha256(t)) IN (SELECT (size, sha256(t)) FROM d GROUP BY size, sha256(t) HAVING count(*) > 1)")
def q_hash_stage(spark, d):
    return pipeline.HashStage().apply(_docs(spark, d)).select(F.col("id").alias("doc_id"), "group_key")


@query(f"WITH RECURSIVE {_LEADERS}, any_ AS (SELECT max(members) AS most FROM lead) SELECT id, 'cluster:' || leader AS group_key, CASE WHEN most > 1 THEN 'duplicates' ELSE 'skip' END AS disposition FROM lead, any_ WHERE members > 1 OR most = 1")
def q_statistical_stage(spark, d):
    return pipeline.StatisticalStage(BatchOptions(similarity_threshold=_CLOSE)).apply(_bench(spark, d)).select("id", "group_key", "disposition")


@query(f"WITH RECURSIVE {_LEADERS}, any_ AS (SELECT max(members) AS most FROM lead) SELECT id, CASE WHEN most > 1 THEN 'cluster:' || leader ELSE 'single:' || id END AS group_key FROM lead, any_ WHERE members > 1 OR most = 1")
def q_pipeline_statistical(spark, d):
    """The stage's verdict ends the run: the clusters, or all rows alone."""
    return pipeline.run_sequential(_bench(spark, d), [pipeline.StatisticalStage(BatchOptions(similarity_threshold=_CLOSE)), pipeline.HashStage()])


@query(f"WITH {_D}, g AS (SELECT size, list(doc_id) AS l FROM d GROUP BY size HAVING count(*) > 1) SELECT size::VARCHAR AS group_key, unnest(l) AS doc_id FROM g")
def q_flatten_groups(spark, d):
    nested = _docs(spark, d).groupBy(F.col("size").cast("string").alias("group_key")).agg(F.collect_list(F.struct(F.col("id").alias("doc_id"))).alias("members")).where("size(members) > 1")
    return pipeline.flatten_groups(nested)


@query(f"WITH {_D} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE sha256(t) END AS checksum FROM d")
def q_checksum_reuse(spark, d):
    """Checksums that are there already are used again."""
    rows = _docs(spark, d).withColumn("checksum", F.when(F.col("id") % 3 == 0, F.lit("known")))
    return grouping.with_checksum(rows).select(F.col("id").alias("doc_id"), "checksum")


@query(f"WITH {_D}, p AS (SELECT size, doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM d) SELECT doc_id, {_UNITS.format('size')} AS shown FROM p")
def q_human_size(spark, d):
    return _docs(spark, d).select(F.col("id").alias("doc_id"), exprs.human_size(F.col("size")).alias("shown"))


@query(f"""WITH {_D}, s AS (SELECT doc_id, size, t, count(*) OVER (PARTITION BY left(hex(encode(t)), 8192), CASE WHEN size > 1024 THEN right(hex(encode(t)), 2048) END) AS n FROM d),
h AS (SELECT *, count(*) OVER (PARTITION BY size, sha256(t)) AS m FROM s WHERE n > 1) SELECT doc_id, 'hash:' || size || ':' || sha256(t) AS group_key FROM h WHERE m > 1""")
def q_pipeline_sequential(spark, d):
    return pipeline.run_sequential(_docs(spark, d), [pipeline.QuickCheckStage(), pipeline.HashStage()]).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_D}, h AS (SELECT *, count(*) OVER (PARTITION BY size, sha256(t)) AS m FROM d) SELECT doc_id, 'size:' || size AS group_key FROM h WHERE m > 1""")
def q_pipeline_parallel(spark, d):
    return pipeline.run_parallel(_docs(spark, d), [pipeline.MetadataStage(), pipeline.HashStage()]).withColumnRenamed("id", "doc_id")


@query(f"WITH {_D} SELECT size, sha256(t) AS checksum, count(*)::BIGINT AS n, sum(size)::BIGINT AS total_size FROM d GROUP BY 1, 2 HAVING count(*) > 1")
def q_stream_exact_duplicates(spark, d):
    at = scratch(spark, "stream")
    path = f"{d}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads a folder; a table in one file is a folder's only file of that name.
    folder, only = (d, "documents.parquet") if len(spark.read.parquet(path).inputFiles()) == 1 and spark.read.parquet(path).inputFiles()[0].endswith("/documents.parquet") else (path, "*.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", only).option("maxFilesPerTrigger", 1000).parquet(folder)
    return groups_of_stream(spark, tables.corpus_of_documents(stream), f"{at}/checkpoint", f"{at}/out")


@query("""WITH RECURSIVE i AS (SELECT item_id, string_split(text, '') AS c FROM benchmark), chars AS (SELECT DISTINCT unnest(c) AS ch FROM i),
coded AS (SELECT ch, row_number() OVER (ORDER BY ch) AS k FROM chars), one AS (SELECT ch, CASE WHEN k < 94 THEN chr((k + 32)::INT) END AS sign FROM coded),
t AS (SELECT item_id, string_agg(sign, '' ORDER BY pos) AS t, count(*) = count(sign) AS fits FROM (SELECT item_id, unnest(c) AS ch, generate_subscripts(c, 1) AS pos FROM i) JOIN one USING (ch) GROUP BY item_id)
SELECT a.item_id AS id_a, b.item_id AS id_b, (CASE WHEN a.fits AND b.fits THEN levenshtein(a.t, b.t) END)::BIGINT AS distance FROM t a JOIN t b ON a.item_id < b.item_id""")
def q_levenshtein_pairs(spark, d):
    """By characters, of all pairs of benchmark items: a test of the function on a small table. The SQL, whose distance is by
    bytes, first gives each character that occurs a sign of one byte; it has 93 of them."""
    t = _read(spark, d, "benchmark").select("item_id", "text")
    a, b = t.select(F.col("item_id").alias("id_a"), F.col("text").alias("a")), t.select(F.col("item_id").alias("id_b"), F.col("text").alias("b"))
    return a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.levenshtein("a", "b").cast("long").alias("distance"))


@query("SELECT strlen(text)::BIGINT AS size, conv_id, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS total_size FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def q_metadata_strategy(spark, d):
    t = _read(spark, d, "conversations")
    rows = t.select(F.octet_length("text").cast("long").alias("size"), F.timestamp_seconds("conv_id").alias("modified"))
    return grouping.same_metadata(rows).select("size", F.unix_seconds("modified").alias("conv_id"), "n", "total_size")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return report.report_members(_big(spark, d))
