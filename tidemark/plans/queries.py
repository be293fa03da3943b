"""The registered queries over the ``events`` table read as a change log, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import access, bloom, compaction, resolve, tiers
from tidemark.sources.changelog import replay_prefix
from tidemark.sources.folders import shared_folder
from tidemark.streaming.ingest import ingest

# Parameters of the registered queries.
TARGET, BEGIN, END, PREFIX, SCAN = "50", "2", "5", "1", 25
BUFFER_BYTES, N_RUNS, N_FILES, SNAPSHOT_SHARE = 16_384, 10, 4, 2
#: Writes of a memory table in the queries over runs of a fixed size, and of a part of a running sum.
RUN_ROWS, PART_ROWS = 1_000, 1 << 20


def to_log(events: DataFrame) -> DataFrame:
    error = F.col("event_type") == "error"
    return events.select(F.col("user_id").cast("string").alias("k"), F.col("event_id").alias("seq"), F.when(error, 0).otherwise(1).alias("typ"), F.when(~error, F.col("props")).alias("v"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_log(_events(spark, sf_dir))


def _batch(spark: SparkSession, sf_dir: str) -> int:
    """Writes in a run, so that there are ten runs. The count comes from the files' footers."""
    return max(1, -(-_events(spark, sf_dir).count() // N_RUNS))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.with_tiers(_log(spark, sf_dir), _batch(spark, sf_dir), N_RUNS - 1)


def _requested(log: DataFrame) -> DataFrame:
    """Every key and as many keys that were never written."""
    keys = log.select("k").distinct()
    return keys.union(keys.select(F.concat("k", F.lit("x"))))


def _first_key(log: DataFrame, typ: int) -> str:
    row = resolve.latest(log).where(F.col("typ") == typ).agg(F.min("k")).first()
    return row[0] or ""


def kv_scan_live(spark, sf_dir):
    return resolve.live(_log(spark, sf_dir)).select("k", "seq", "v")


def kv_scan_versions(spark, sf_dir):
    return resolve.versions(_log(spark, sf_dir))


def kv_get(spark, sf_dir):
    log = _log(spark, sf_dir)
    return access.get(log, _first_key(log, resolve.VALUE))


def kv_get_deleted(spark, sf_dir):
    log = _log(spark, sf_dir)
    key = _first_key(log, resolve.DELETION)
    return access.multi_get(log, spark.createDataFrame([(key,)], "k string"))


def kv_run_get(spark, sf_dir):
    log = tiers.with_run(_log(spark, sf_dir), _batch(spark, sf_dir)).where("run = 0")
    return access.get(log, _first_key(log, resolve.VALUE))


def kv_multi_get(spark, sf_dir):
    log = _log(spark, sf_dir)
    return access.multi_get(log, _requested(log))


def kv_contains(spark, sf_dir):
    log = _log(spark, sf_dir)
    return access.contains(log, _requested(log))


def kv_seek(spark, sf_dir):
    return access.seek(_log(spark, sf_dir), TARGET)


def kv_seek_scan(spark, sf_dir):
    return access.seek_scan(_log(spark, sf_dir), TARGET, SCAN)


def kv_range_scan(spark, sf_dir):
    return access.range_scan(_log(spark, sf_dir), BEGIN, END)


def kv_prefix_scan(spark, sf_dir):
    return access.prefix_scan(_log(spark, sf_dir), PREFIX)


def kv_overwrite_latest(spark, sf_dir):
    return resolve.overwritten(_log(spark, sf_dir))


def kv_delete_then_put(spark, sf_dir):
    return resolve.restored(_log(spark, sf_dir))


def kv_empty_value_is_delete(spark, sf_dir):
    emptied = _log(spark, sf_dir).withColumns({"typ": F.lit(1), "v": F.coalesce("v", F.lit(""))})
    return resolve.latest(resolve.normalise(emptied)).select("k", "typ")


def kv_apply_log(spark, sf_dir):
    return _log(spark, sf_dir).select("k", "seq", "typ")


def kv_recover(spark, sf_dir):
    """Flushed runs, united with the tail of the log beyond the last flushed write."""
    rows = _tiers(spark, sf_dir)
    runs = rows.where("level >= 0").select("k", "seq", "typ", "v")
    last = runs.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    tail = _log(spark, sf_dir).join(F.broadcast(last), F.col("seq") > F.col("last")).drop("last")
    return resolve.live(runs.unionByName(tail)).select("k", "seq", "v")


def kv_wal_replay(spark, sf_dir):
    """The log is damaged at nine tenths of its length."""
    bad = _events(spark, sf_dir).count() * 9 // 10
    return replay_prefix(_log(spark, sf_dir), F.col("seq") >= bad).select("k", "seq", "typ")


def kv_wal_encode_len(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", codec.record_length(F.col("k"), F.col("v")).alias("n_bytes"))


def kv_memtable_rotation(spark, sf_dir):
    return tiers.rotation(_log(spark, sf_dir), BUFFER_BYTES, PART_ROWS)


def kv_memtable_scan(spark, sf_dir):
    return resolve.versions(_tiers(spark, sf_dir).where(F.col("level") == tiers.MEM).select("k", "seq", "v"))


def kv_run_scan(spark, sf_dir):
    return resolve.versions(_tiers(spark, sf_dir).where("run = 5").select("k", "seq", "v"))


def kv_flush_run_stats(spark, sf_dir):
    return tiers.run_stats(_tiers(spark, sf_dir))


def kv_run_metadata(spark, sf_dir):
    rows = _tiers(spark, sf_dir)
    return rows.groupBy(F.col("level").cast("int").alias("level"), "run").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def kv_manifest(spark, sf_dir):
    return tiers.manifest(_tiers(spark, sf_dir)).withColumn("level", F.col("level").cast("int"))


def kv_block_index(spark, sf_dir):
    return tiers.block_index(tiers.with_run(_log(spark, sf_dir), RUN_ROWS))


def kv_restart_points(spark, sf_dir):
    return tiers.restart_points(tiers.with_run(_log(spark, sf_dir), RUN_ROWS))


def kv_read_tier(spark, sf_dir):
    return tiers.read_tier(_tiers(spark, sf_dir))


def kv_run_candidates(spark, sf_dir):
    return tiers.candidates(_log(spark, sf_dir).select("k").distinct(), tiers.manifest(_tiers(spark, sf_dir)))


def _bottom(spark, sf_dir) -> DataFrame:
    return compaction.compact(_tiers(spark, sf_dir).where("level = 1").select("k", "seq", "typ", "v"))


def _files(spark, sf_dir) -> DataFrame:
    return compaction.outputs(_bottom(spark, sf_dir), N_FILES)


def kv_l1_locate(spark, sf_dir):
    return tiers.candidates(_log(spark, sf_dir).select("k").distinct(), _files(spark, sf_dir).withColumnRenamed("file", "run"))


def kv_compaction_inputs(spark, sf_dir):
    return compaction.overlapping(tiers.run_stats(_tiers(spark, sf_dir)))


def kv_need_compaction(spark, sf_dir):
    return compaction.need(_tiers(spark, sf_dir))


def kv_merge_runs(spark, sf_dir):
    rows = _tiers(spark, sf_dir)
    return compaction.merge_runs([rows.where(F.col("run") == r).select("k", "seq", "typ") for r in (2, 5, 7)])


def kv_compact(spark, sf_dir):
    return compaction.compact(_tiers(spark, sf_dir).where("level >= 0").select("k", "seq", "typ", "v")).select("k", "seq", "v")


def kv_compact_range(spark, sf_dir):
    return compaction.compact_range(_log(spark, sf_dir), BEGIN, END).select("k", "seq", "typ")


def kv_compaction_outputs(spark, sf_dir):
    return _files(spark, sf_dir)


def kv_manifest_after_compact(spark, sf_dir):
    rows = _tiers(spark, sf_dir)
    now = tiers.manifest(rows)
    files = _files(spark, sf_dir).select(F.lit(1).alias("level"), (F.col("file") + 100).alias("run"), "first_key", "last_key")
    return compaction.after_compaction(now, now.where("level = 1"), files).withColumn("level", F.col("level").cast("int"))


def kv_internal_key(spark, sf_dir):
    packed = _log(spark, sf_dir).withColumn("packed", codec.pack(F.col("seq"), F.col("typ")))
    return packed.select("k", codec.unpack_seq(F.col("packed")).alias("seq"), codec.unpack_type(F.col("packed")).alias("typ"))


def kv_slice_scalars(spark, sf_dir):
    keys = _log(spark, sf_dir).select("k").distinct()
    return keys.select("k", F.octet_length("k").cast("long").alias("n"), F.substring("k", 1, 1).alias("head"), F.substring("k", 2, 100).alias("rest"), F.col("k").startswith("1").alias("starts"), (F.col("k") == "7").alias("same"), (F.col("k") < "5").alias("less"), (F.length("k") == 0).alias("empty"))


def kv_varint_len(spark, sf_dir):
    power = F.pow(F.lit(2.0), F.col("seq") % 32).cast("long")
    return _log(spark, sf_dir).select("seq", codec.varint_length(power).alias("n"))


def kv_fnv1a(spark, sf_dir):
    return _log(spark, sf_dir).select("k").distinct().select("k", codec.fnv1a(F.col("k")).alias("h"))


def kv_bloom_positions(spark, sf_dir):
    keys = _log(spark, sf_dir).select("k").distinct()
    return keys.select("k", F.posexplode(codec.bloom_positions(codec.fnv1a(F.col("k")), F.lit(1024)))).select("k", F.col("pos").cast("long").alias("i"), F.col("col").alias("bit"))


def kv_bloom_build(spark, sf_dir):
    return bloom.build(_tiers(spark, sf_dir))


def kv_bloom_probe(spark, sf_dir):
    rows = _tiers(spark, sf_dir)
    return bloom.probe(_requested(rows), rows)


def kv_bloom_fpr(spark, sf_dir):
    """Runs of distinct keys, each order being one, so that filters are as full as they get; every key's absent twin is asked."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = orders.select(F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % N_RUNS).cast("long").alias("run"))
    return bloom.false_positives(keys.select(F.concat(F.lit("absent_"), "k").alias("k")), keys)


def kv_record_crc(spark, sf_dir):
    """CRC-32 of each key, the checksum of log records."""
    return _log(spark, sf_dir).select("k").distinct().select("k", F.crc32(F.col("k").cast("binary")).alias("crc"))


def kv_as_of(spark, sf_dir):
    half = _batch(spark, sf_dir) * N_RUNS // SNAPSHOT_SHARE
    return resolve.as_of(_log(spark, sf_dir), half).select("k", "seq", "v")


def kv_rollup(spark, sf_dir):
    """Entries and bytes by level and run, with subtotals."""
    rows = _tiers(spark, sf_dir).withColumn("level", F.col("level").cast("int"))
    return rows.rollup("level", "run").agg(F.count(F.lit(1)).alias("n"), F.sum(tiers.payload_bytes(F.col("k"), F.col("v"))).cast("long").alias("bytes"))


def kv_stream_ingest(spark, sf_dir):
    """The live set after the events came in as a stream."""
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = _events(spark, sf_dir)
    log = ingest(spark, events.schema, sf_dir, f"{work}/runs", f"{work}/checkpoint", to_log, "events*.parquet")
    return resolve.live(log).select("k", "seq", "v")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("kv_")}

# SQL. The log and what is derived from it stand in front of each query that uses them.
LOG = """WITH log AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS typ,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v FROM events),
latest AS (SELECT k, seq, typ, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT * FROM latest WHERE typ = 1),
keys AS (SELECT DISTINCT k FROM log),
size AS (SELECT greatest(1, CAST((count(*) + 9) // 10 AS BIGINT)) AS batch FROM log),
runs AS (SELECT log.*, CAST(seq // batch AS BIGINT) AS run FROM log, size),
tiers AS (SELECT *, CASE WHEN 9 - run = 0 THEN -2 WHEN 9 - run = 1 THEN -1 WHEN 9 - run <= 5 THEN 0 ELSE 1 END AS level FROM runs),
wanted AS (SELECT k FROM keys UNION ALL SELECT k || 'x' FROM keys),
manifest AS (SELECT level, run, min(k) AS first_key, max(k) AS last_key FROM tiers WHERE level >= 0 GROUP BY level, run),
bottom AS (SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM tiers WHERE level = 1) WHERE rn = 1 AND typ = 1),
files AS (SELECT CAST(file AS BIGINT) AS file, min(k) AS first_key, max(k) AS last_key, count(*) AS n FROM (SELECT k, ntile(4) OVER (ORDER BY k) - 1 AS file FROM bottom) GROUP BY file)
"""
VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
KLEN, VLEN = "(strlen(k) + 8)", "coalesce(strlen(v), 0)"
ENTRY = f"1 + {VARINT.format(KLEN)} + {KLEN} + {VARINT.format(VLEN)} + {VLEN}"
PAYLOAD = f"{KLEN} + {VLEN}"
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substring(k, CAST(i AS BIGINT), 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substring(k, CAST(i AS BIGINT), 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, s: xor(x >> 1, 3988292384 * (x & 1))))"
BIT = "(((h + i * ((h // 131072) + (h % 131072) * 32768)) & 4294967295) % bits)"
BLOOM = f""", hashed AS (SELECT k, {FNV} AS h FROM keys), six AS (SELECT unnest(range(0, 6)) AS i),
bits AS (SELECT run, CAST((greatest(count(*) * 10, 64) + 7) // 8 * 8 AS BIGINT) AS bits FROM tiers GROUP BY run),
built AS (SELECT DISTINCT run, CAST({BIT} AS BIGINT) AS bit FROM (SELECT DISTINCT run, k FROM tiers) JOIN hashed USING (k) JOIN bits USING (run), six)
"""
PROBE = f""", asked AS (SELECT DISTINCT k FROM {{0}}), ahash AS (SELECT k, {FNV} AS h FROM asked),
each AS (SELECT DISTINCT k, run, CAST({BIT} AS BIGINT) AS bit FROM ahash, bits, six),
probed AS (SELECT each.k, each.run, bool_and(built.bit IS NOT NULL) AS maybe FROM each LEFT JOIN built ON each.run = built.run AND each.bit = built.bit GROUP BY each.k, each.run)
"""

ORACLES = {
    "kv_scan_live": LOG + "SELECT k, seq, v FROM live",
    "kv_scan_versions": LOG + "SELECT k, seq, typ, v FROM log ORDER BY k, seq DESC",
    "kv_get": LOG + "SELECT k, v FROM live WHERE k = (SELECT min(k) FROM live)",
    "kv_get_deleted": LOG + "SELECT k, 'NotFound: deleted' AS status, CAST(NULL AS VARCHAR) AS v FROM latest WHERE k = (SELECT min(k) FROM latest WHERE typ = 0)",
    "kv_run_get": LOG + ", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM runs WHERE run = 0) WHERE rn = 1 AND typ = 1) SELECT k, v FROM one WHERE k = (SELECT min(k) FROM one)",
    "kv_multi_get": LOG + "SELECT w.k, CASE WHEN l.typ IS NULL THEN 'NotFound' WHEN l.typ = 0 THEN 'NotFound: deleted' ELSE 'OK' END AS status, CASE WHEN l.typ = 1 THEN l.v END AS v FROM wanted w LEFT JOIN latest l ON w.k = l.k",
    "kv_contains": LOG + "SELECT k FROM wanted WHERE k IN (SELECT k FROM live)",
    "kv_seek": LOG + f"SELECT k, v FROM live WHERE k >= '{TARGET}' ORDER BY k LIMIT 1",
    "kv_seek_scan": LOG + f"SELECT k, v FROM live WHERE k >= '{TARGET}' ORDER BY k LIMIT {SCAN}",
    "kv_range_scan": LOG + f"SELECT k, v FROM live WHERE k >= '{BEGIN}' AND k < '{END}' ORDER BY k",
    "kv_prefix_scan": LOG + f"SELECT k, v FROM live WHERE starts_with(k, '{PREFIX}') ORDER BY k",
    "kv_overwrite_latest": LOG + "SELECT live.k, v, n AS n_versions FROM live JOIN (SELECT k, count(*) AS n FROM log GROUP BY k) c ON live.k = c.k",
    "kv_delete_then_put": LOG + "SELECT k, seq, v FROM (SELECT *, lag(typ) OVER w AS b, lead(seq) OVER w AS a FROM log WINDOW w AS (PARTITION BY k ORDER BY seq)) WHERE a IS NULL AND typ = 1 AND b = 0",
    "kv_empty_value_is_delete": LOG + "SELECT k, CASE WHEN coalesce(length(v), 0) = 0 THEN 0 ELSE 1 END AS typ FROM latest",
    "kv_apply_log": LOG + "SELECT k, seq, typ FROM log",
    "kv_recover": LOG + "SELECT k, seq, v FROM live",
    "kv_wal_replay": LOG + "SELECT k, seq, typ FROM log WHERE seq < coalesce((SELECT min(seq) FROM log WHERE seq >= (SELECT count(*) * 9 // 10 FROM log)), 9223372036854775807)",
    "kv_wal_encode_len": LOG + f"SELECT seq, CAST({ENTRY} + 4 AS BIGINT) AS n_bytes FROM log",
    "kv_memtable_rotation": LOG + f"SELECT seq, CAST(coalesce(sum({PAYLOAD}) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BUFFER_BYTES} AS BIGINT) AS mem_id FROM log",
    "kv_memtable_scan": LOG + "SELECT k, seq, v FROM tiers WHERE level = -2",
    "kv_run_scan": LOG + "SELECT k, seq, v FROM tiers WHERE run = 5",
    "kv_flush_run_stats": LOG + f"SELECT run, min(k) AS first_key, max(k) AS last_key, count(*) AS n, CAST(sum(CASE WHEN typ = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, CAST(sum({PAYLOAD}) AS BIGINT) AS bytes FROM tiers GROUP BY run",
    "kv_run_metadata": LOG + "SELECT level, run, min(k) AS first_key, max(k) AS last_key, min(seq) AS first_seq, max(seq) AS last_seq FROM tiers GROUP BY level, run",
    "kv_manifest": LOG + "SELECT level, run, first_key, last_key FROM manifest",
    "kv_block_index": LOG.replace("WITH", "WITH RECURSIVE", 1) + f""", entries AS (SELECT run, k, {ENTRY} AS size, row_number() OVER (PARTITION BY run ORDER BY k, seq DESC) AS rn FROM (SELECT *, seq // {RUN_ROWS} AS run FROM log)),
packed AS (SELECT run, k, rn, CAST(0 AS BIGINT) AS block_no, CAST(size AS BIGINT) AS filled FROM entries WHERE rn = 1
  UNION ALL SELECT e.run, e.k, e.rn, CASE WHEN p.filled + e.size > 4096 THEN p.block_no + 1 ELSE p.block_no END, CASE WHEN p.filled + e.size > 4096 THEN CAST(e.size AS BIGINT) ELSE CAST(p.filled + e.size AS BIGINT) END
  FROM packed p JOIN entries e ON e.run = p.run AND e.rn = p.rn + 1)
SELECT run, block_no, count(*) AS n, max(k) AS last_key FROM packed GROUP BY run, block_no""",
    "kv_restart_points": LOG + f"SELECT run, seq, pos FROM (SELECT run, seq, CAST(row_number() OVER (PARTITION BY run ORDER BY k, seq DESC) - 1 AS BIGINT) AS pos FROM (SELECT *, seq // {RUN_ROWS} AS run FROM log)) WHERE pos % 16 = 0",
    "kv_read_tier": LOG + "SELECT k, level AS tier FROM (SELECT k, level, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM tiers) WHERE rn = 1",
    "kv_run_candidates": LOG + "SELECT k, run FROM keys JOIN manifest ON k >= first_key AND k <= last_key",
    "kv_l1_locate": LOG + "SELECT k, file AS run FROM keys JOIN files ON k >= first_key AND k <= last_key",
    "kv_compaction_inputs": LOG + ", b AS (SELECT run, min(k) AS f, max(k) AS l FROM tiers GROUP BY run) SELECT x.run AS run_a, y.run AS run_b FROM b x JOIN b y ON x.run < y.run AND x.l >= y.f AND y.l >= x.f",
    "kv_need_compaction": LOG + "SELECT level, count(DISTINCT run) AS n, level = 0 AND count(DISTINCT run) >= 4 AS flag FROM tiers WHERE level >= 0 GROUP BY level",
    "kv_merge_runs": LOG + "SELECT k, seq, typ FROM tiers WHERE run IN (2, 5, 7) ORDER BY k, seq DESC",
    "kv_compact": LOG + "SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM tiers WHERE level >= 0) WHERE rn = 1 AND typ = 1",
    "kv_compact_range": LOG + f"SELECT k, seq, typ FROM live WHERE k >= '{BEGIN}' AND k < '{END}' UNION ALL SELECT k, seq, typ FROM log WHERE NOT (k >= '{BEGIN}' AND k < '{END}')",
    "kv_compaction_outputs": LOG + "SELECT file, first_key, last_key, n FROM files",
    "kv_manifest_after_compact": LOG + "SELECT level, run, first_key, last_key FROM manifest WHERE level <> 1 UNION ALL SELECT 1, file + 100, first_key, last_key FROM files",
    "kv_internal_key": LOG + "SELECT k, seq, typ FROM log",
    "kv_slice_scalars": LOG + "SELECT k, CAST(strlen(k) AS BIGINT) AS n, k[1:1] AS head, k[2:] AS rest, starts_with(k, '1') AS starts, k = '7' AS same, k < '5' AS less, length(k) = 0 AS empty FROM keys",
    "kv_varint_len": LOG + f"SELECT seq, CAST({VARINT.format('(CAST(pow(2, seq % 32) AS BIGINT))')} AS BIGINT) AS n FROM log",
    "kv_fnv1a": LOG + f"SELECT k, CAST({FNV} AS BIGINT) AS h FROM keys",
    "kv_bloom_positions": LOG + BLOOM + f"SELECT k, CAST(i AS BIGINT) AS i, CAST({BIT} AS BIGINT) AS bit FROM (SELECT k, h, 1024 AS bits FROM hashed), six",
    "kv_bloom_build": LOG + BLOOM + "SELECT run, bit FROM built",
    "kv_bloom_probe": LOG + BLOOM + PROBE.format("wanted") + "SELECT k, run, maybe FROM probed",
    "kv_bloom_fpr": "WITH tiers AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_orderkey % 10 AS BIGINT) AS run FROM orders), keys AS (SELECT DISTINCT k FROM tiers)" + BLOOM + PROBE.format("(SELECT 'absent_' || k AS k FROM keys)") + "SELECT run, count(*) AS probes, CAST(sum(CAST(maybe AS BIGINT)) AS BIGINT) AS hits FROM probed GROUP BY run",
    "kv_record_crc": LOG + f"SELECT k, CAST(xor({CRC}, 4294967295) AS BIGINT) AS crc FROM keys",
    "kv_as_of": LOG + ", o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= (SELECT batch * 10 // 2 FROM size)) SELECT k, seq, v FROM o WHERE rn = 1 AND typ = 1",
    "kv_rollup": LOG + f"SELECT level, run, count(*) AS n, CAST(sum({PAYLOAD}) AS BIGINT) AS bytes FROM tiers GROUP BY ROLLUP (level, run)",
    "kv_stream_ingest": LOG + "SELECT k, seq, v FROM live",
}
