import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.sources import changelog as C


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([C.PUT, C.DELETE]), st.binary(max_size=40), st.binary(max_size=200))), st.integers(0, 50))
def test_log_round_trip_and_prefix(records, cut):
    data = C.encode(records)
    assert list(C.decode(data)) == records
    short = list(C.decode(data[: max(0, len(data) - cut)]))
    assert short == records[: len(short)]


def test_varint_lengths_and_damage(spark):
    for n, size in ((0, 1), (127, 1), (128, 2), (300, 2), (16383, 2), (16384, 3), (2**32 - 1, 5)):
        assert len(C.put_varint(n)) == size and C.get_varint(C.put_varint(n), 0) == (n, size)
    data = bytearray(C.encode([(C.PUT, b"k", b"v")]))
    data[-1] ^= 1
    assert list(C.decode(bytes(data))) == [] and list(C.decode(b"")) == []
    got = spark.createDataFrame([(n,) for n in (0, 127, 128, 16383, 16384, 2**32 - 1)], "n long").select(codec.varint_length(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in got] == [1, 1, 2, 2, 3, 5]


def test_checksum_and_hash(spark):
    row = spark.range(1).select(F.crc32(F.lit(b"hello")).alias("c"), F.crc32(F.lit(b"")).alias("e"), codec.fnv1a(F.lit("aé")).alias("h"), codec.fnv1a(F.lit("")).alias("z")).first()
    h = codec.FNV_SEED
    for byte in "aé".encode():
        h = (h ^ byte) * codec.FNV_PRIME & codec.MASK32
    assert (row["c"], row["e"], row["h"], row["z"]) == (zlib.crc32(b"hello"), 0, h, codec.FNV_SEED)


def test_read_logs_and_source(spark, tmp_path):
    records = [(C.PUT, b"a\x00b", b"1"), (C.DELETE, b"a\x00b", b""), (C.PUT, b"c", b"")]
    (tmp_path / "x.log").write_bytes(C.encode(records) + b"\x01\x83")
    got = [(r["no"], r["typ"], bytes(r["key"])) for r in C.read_logs(spark, str(tmp_path)).orderBy("no").collect()]
    assert got == [(0, 1, b"a\x00b"), (1, 0, b"a\x00b"), (2, 0, b"c")]
    spark.dataSource.register(C.ChangeLogSource)
    again = spark.read.format("changelog").load(str(tmp_path / "x.log")).orderBy("no").collect()
    assert [(r["no"], r["typ"], bytes(r["key"])) for r in again] == got
