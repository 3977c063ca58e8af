"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(tables: str, sql: str | None = None):
    """Register ``fn`` of the tables named in ``tables``."""

    def wrap(fn: Callable[..., DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables.split()])
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


@_query(
    "documents",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g""",
)
def op4_exact_dedup(documents: DataFrame) -> DataFrame:
    from tablewise.llm.exact_dedup import exact_groups

    return exact_groups(documents).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@_query(
    "documents",
    r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY key = 'n', key) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM p),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM p) AS DOUBLE) * 1.5::DOUBLE
    - CAST(coalesce(sum(source_size) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0::DOUBLE)
    / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
r AS (SELECT min(level) FILTER (WHERE o) AS reached FROM (SELECT level, level * weight <= source_size * 2.0::DOUBLE AS o, source_size * 2.0::DOUBLE / weight AS at_cap,
    min(CASE WHEN level * weight <= source_size * 2.0::DOUBLE THEN source_size * 2.0::DOUBLE / weight END) OVER () AS first_cap FROM l) WHERE at_cap = first_cap),
t AS (SELECT key, source_size, least(source_size * 2.0::DOUBLE, reached * weight) AS target FROM l, r),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 4294967296.0::DOUBLE + 0.5::DOUBLE) AS HUGEINT) ELSE 0 END AS expected,
    length(CAST(size AS VARCHAR)) * 100 + CAST(substr(rpad(CAST(size AS VARCHAR), 2, '0'), 1, 2) AS INT) AS band,
    md5('7:' || CAST(doc_id AS VARCHAR)) AS draw, CAST('0x' || substr(md5('7:' || d.key), 1, 8) AS BIGINT) AS u FROM d JOIN t ON d.key = t.key),
s AS (SELECT *, CAST(sum(expected) OVER (PARTITION BY key ORDER BY band, draw, doc_id ROWS UNBOUNDED PRECEDING) AS HUGEINT) + u AS upto FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((upto // 4294967296 - (upto - expected) // 4294967296) * size AS BIGINT) AS taken FROM s""",
)
def op8_source_mixing(documents: DataFrame) -> DataFrame:
    from tablewise.llm.mixing import copies

    return copies(documents).withColumn("taken", F.col("copies") * F.col("size")).drop("copies")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("documents")
def op2_best_fit_packing(documents: DataFrame) -> DataFrame:
    from tablewise.llm.packing import packed

    return packed(documents, tokenizer_path())


@_query("documents")
def op3_token_files(documents: DataFrame) -> DataFrame:
    from tablewise.llm.token_files import read_ids, write_ids

    spark = documents.sparkSession
    path = shared_path(spark, "token-files")
    write_ids(documents, path, tokenizer_path())
    return read_ids(spark, path)


@_query("documents")
def op5_language_id(documents: DataFrame) -> DataFrame:
    from tablewise.llm.languages import identified

    return identified(documents)


@_query("documents")
def op9_jaccard_join(documents: DataFrame) -> DataFrame:
    from tablewise.llm.jaccard_join import similar

    return similar(documents, size=3, num=90, den=100)


#: Rules of the query: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words of a small labelled URL table for tests. They resemble hosts of the test tables, so the query does not learn from them.
UNWANTED_HOSTS = (
    "casino-win online-casino casino-bonus win-jackpot poker-slots slots-free free-bets bets-now sport-bets lucky-bets "
    "cheap-pills pills-shop buy-pills cheap-meds diet-pills cheap-watches cheap-loans spam-farm link-farm farm-links content-spam spam-mail "
    "ads-track track-clicks click-ads pop-ads ads-server ad-tracker adult-x adult-cam xxx-video adult-dating free-xxx hot-cams"
).split()
WANTED_HOSTS = (
    "library museum weather history garden recipes science physics teacher school university city-council train-times gazette "
    "mountain river orchestra theatre painter bakery cycling running chess astronomy geology forest harbour village parliament "
    "health hospital dentist lawyer builder market auction insurance travel islands northern southern western eastern "
    "thelen therin thorn shein ering onter eastin handel reston steinau oulen blesh tionar wharton atlin esher ingle nettle"
).split()
URL_FRAMES = ("https://{}.com/en/{}", "http://www.{}.org/de/{}.html", "https://blog.{}.net/fr/{}/", "https://m.{}.example.com/es/{}", "http://{}.example.org/en/{}", "https://{}.example.net/{}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """Some hundred labelled URLs: every host in every frame."""
    rows = [(f.format(h, 17 * i + k), kind) for kind, hosts in ((1, UNWANTED_HOSTS), (0, WANTED_HOSTS)) for i, h in enumerate(hosts) for k, f in enumerate(URL_FRAMES)]
    return spark.createDataFrame(rows, "url string, blocked int")


@_query("pages")
def op7_url_filter(pages: DataFrame) -> DataFrame:
    from tablewise.llm.url_filter import judged

    return judged(pages, URL_RULES)


@_query("documents labels")
def op10_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    from tablewise.llm.quality import scored

    return scored(documents, labels)


@_query(
    "embeddings",
    """
WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM p),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
)
def op6_exact_top_k(embeddings: DataFrame) -> DataFrame:
    from tablewise.llm.top_k import top_k

    return top_k(embeddings, F.col("vec_id") % 100 == 0)


@_query("documents")
def op1_substring_dedup(documents: DataFrame) -> DataFrame:
    from tablewise.llm.substrings import without_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(documents, 20).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@_query(
    "conversations",
    r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS again FROM kinds WHERE k <> 0),
rows_ AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM rows_),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'),
    (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
    (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:'), (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS v(p, q, marks, lines)),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(p, ini, q)),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM faults
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
      SELECT j.conv_id, j.i, CASE e.edit WHEN 'D' THEN s.q WHEN 'K' THEN m.q ELSE CASE WHEN s.q = 2 THEN 3 ELSE 2 END END AS q,
        s.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e.edit <> 'D' AND j.fault = 't' THEN 3 ELSE 0 END AS cost, s.audit || e.edit AS audit,
        s.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text ELSE chr(10) || CASE WHEN s.q = 2 THEN 'assistant' ELSE 'user' END || ':' || j.text END AS lines
      FROM (SELECT w.conv_id, w.i, x.q, w.cost + 3 * length(x.marks) AS cost, w.audit || x.marks AS audit, w.lines || x.lines AS lines FROM walk w JOIN inserts x ON x.p = w.q) s
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1
      JOIN (VALUES ('D'), ('K'), ('R')) AS e(edit) ON e.edit = 'D' OR j.fault NOT IN ('b', 'd')
      LEFT JOIN moves m ON m.p = s.q AND m.ini = j.ini AND e.edit = 'K'
      WHERE e.edit <> 'K' OR m.q IS NOT NULL)) WHERE best = 1),
ends AS (SELECT w.conv_id, w.cost + 3 * length(x.marks) AS cost, w.audit || x.marks AS audit, w.lines || x.lines AS lines,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(x.marks), w.audit || x.marks) AS best
  FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN inserts x ON x.p = w.q WHERE x.q IN (0, 3))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.best = 1""",
)
def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    from tablewise.llm.conversations import digests, repaired, with_conv_id

    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.coalesce("text", space)
    damaged = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    report, turns = repaired(damaged, F.col("copies"))
    texts = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    report = report.join(digests(turns), "conv", "left").withColumn("repaired_sha256", texts)
    return with_conv_id(report).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@_query("documents")
def op12_sharding(documents: DataFrame) -> DataFrame:
    from tablewise.llm.sharding import sharded

    rows, maps = sharded(documents, 8)
    columns = [F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(maps[-1].version).alias("map_version")]
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", *columns)


@_query("embeddings")
def op13_whitening(embeddings: DataFrame) -> DataFrame:
    from tablewise.llm.whitening import whitened

    return whitened(embeddings, 16)
