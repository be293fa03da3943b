"""Bloom filters: of runs as rows of set bits, in column expressions, and one at a time on the driver."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import BITS_PER_KEY, FNV_PRIME, FNV_SEED, HASHES, MASK32, bloom_bits, bloom_positions, fnv1a


def sizes(runs: DataFrame) -> DataFrame:
    """run and bits: filters count entries, repeated keys included."""
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("entries")).select("run", bloom_bits(F.col("entries")).alias("bits"))


def build(runs: DataFrame) -> DataFrame:
    """run and bit: the distinct bits set in the filter of each run."""
    keys = runs.select("run", "k").distinct().join(sizes(runs), "run")
    return keys.select("run", F.explode(bloom_positions(fnv1a(F.col("k")), F.col("bits"))).alias("bit")).distinct()


def probe(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """k, run and maybe: whether the filter of each run may hold k (never false for a key that it holds).

    A key's positions are joined with the set bits and counted, so filters are never gathered in one place.
    """
    # every key is held against every run: the runs are one array for all keys, as many numbers as there are runs
    of_runs = sizes(runs).agg(F.collect_list(F.struct("run", "bits")).alias("of_runs"))
    asked = keys.select("k").distinct().withColumn("h", fnv1a(F.col("k"))).join(of_runs).select("k", "h", F.explode("of_runs").alias("r"))
    asked = asked.select("k", "r.run", F.array_distinct(bloom_positions(F.col("h"), F.col("r.bits"))).alias("bits"))
    each = asked.select("k", "run", F.size("bits").alias("need"), F.explode("bits").alias("bit"))
    hit = each.join(build(runs).withColumn("on", F.lit(1)), ["run", "bit"], "left")
    return hit.groupBy("k", "run", "need").agg(F.count("on").alias("got")).select("k", "run", (F.col("got") == F.col("need")).alias("maybe"))


def false_positives(absent: DataFrame, runs: DataFrame) -> DataFrame:
    """run, probes and hits over keys that no run holds."""
    return probe(absent, runs).groupBy("run").agg(F.count(F.lit(1)).alias("probes"), F.sum(F.col("maybe").cast("long")).alias("hits"))


class BloomFilter:
    """One filter on the driver, for keys that come one by one. The same bits as ``build`` sets for a run.

    Encoded, it is bits per key and hash functions in 4 little-endian bytes each, then the bits.
    """

    def __init__(self, entries: int = 0, bits: bytes | None = None):
        size = max(64, entries * BITS_PER_KEY)
        self.bits = bytearray(-(-size // 8)) if bits is None else bytearray(bits)

    def _positions(self, key: bytes) -> list[int]:
        h = FNV_SEED
        for byte in key:
            h = (h ^ byte) * FNV_PRIME & MASK32
        delta = h >> 17 | h << 15 & MASK32
        return [(h + i * delta & MASK32) % (8 * len(self.bits)) for i in range(HASHES)]

    def add(self, key: bytes) -> None:
        for at in self._positions(key):
            self.bits[at >> 3] |= 1 << (at & 7)

    def may_contain(self, key: bytes) -> bool:
        return bool(self.bits) and all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._positions(key))

    def encode(self) -> bytes:
        return struct.pack("<II", BITS_PER_KEY, HASHES) + bytes(self.bits)

    @classmethod
    def decode(cls, data: bytes) -> BloomFilter:
        if len(data) < 8 or struct.unpack_from("<II", data) != (BITS_PER_KEY, HASHES):
            raise ValueError("not a filter of this kind")
        return cls(bits=data[8:])

    def clear(self) -> None:
        self.bits = bytearray(len(self.bits))
