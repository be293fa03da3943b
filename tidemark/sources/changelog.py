"""Binary change logs: encoding, decoding and a Spark data source for them.

A record is: type (1 put, 2 delete), varint length and bytes of the key, varint length and bytes of the value,
CRC-32 of all that in 4 little-endian bytes. Replay keeps the records before the first that is cut short or
fails its checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import ship_package

PUT, DELETE = 1, 2


class Corruption(Exception):
    """Data that fails a check."""


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` and the place after it."""
    value = 0
    for k in range(10):
        byte = data[at + k]
        value |= (byte & 127) << 7 * k
        if byte < 128:
            return value, at + k + 1
    raise Corruption("varint is too long")


def encode(records: Iterable[tuple[int, bytes, bytes]]) -> bytes:
    out = bytearray()
    for kind, key, value in records:
        body = bytes([kind]) + put_varint(len(key)) + key + put_varint(len(value)) + value
        out += body + struct.pack("<I", zlib.crc32(body))
    return bytes(out)


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Records up to the first damaged one."""
    at = 0
    while at < len(data):
        try:
            kind = data[at]
            size, k = get_varint(data, at + 1)
            key = data[k : k + size]
            size, v = get_varint(data, k + size)
            value, end = data[v : v + size], v + size
            (crc,) = struct.unpack_from("<I", data, end)
        except (IndexError, struct.error, Corruption):
            return
        if zlib.crc32(data[at:end]) != crc or kind not in (PUT, DELETE):
            return
        yield kind, key, value
        at = end + 4


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, no, typ (1 value, 0 deletion), key, value of all log files under ``path``; each file in one task."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(decode(content))
                columns = [
                    pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()),
                    pa.array([int(kind == PUT and len(v) > 0) for kind, _, v in rows], pa.int32()),
                    pa.array([k for _, k, _ in rows], pa.binary()), pa.array([v or None for _, _, v in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "no", "typ", "key", "value"])

    return files.mapInArrow(run, "file string, no bigint, typ int, key binary, value binary")


def replay_prefix(log: DataFrame, bad) -> DataFrame:
    """The records of a log before the first for which the condition ``bad`` holds."""
    first = log.agg(F.min(F.when(bad, F.col("seq"))).alias("cut"))
    return log.join(F.broadcast(first), F.col("seq") < F.coalesce("cut", F.lit((1 << 63) - 1))).drop("cut")


try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class ChangeLogSource(DataSource):
        """``spark.read.format("changelog").load(file)`` for a log file that every executor can open."""

        @classmethod
        def name(cls) -> str:
            return "changelog"

        def schema(self) -> str:
            return "no bigint, typ int, key binary, value binary"

        def reader(self, schema) -> DataSourceReader:
            return ChangeLogReader(self.options["path"])

    class ChangeLogReader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path.removeprefix("file://")

        def partitions(self):
            return [InputPartition(self.path)]

        def read(self, partition):
            with open(partition.value, "rb") as file:
                for no, (kind, key, value) in enumerate(decode(file.read())):
                    yield no, int(kind == PUT and len(value) > 0), key, value or None

except ImportError:  # no Python data sources before Spark 4
    ChangeLogSource = None
