"""Scalar functions over keys and records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest sequence number; with an 8-bit type it fills 64 bits.
MAX_SEQ = (1 << 56) - 1
#: FNV-1a, 32 bits.
FNV_SEED, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
#: Bytes that follow a user key in a stored key.
TRAILER_BYTES = 8
#: Bits of a Bloom filter for each key, and hash functions (0.69 of it).
BITS_PER_KEY, HASHES = 10, 6


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned LEB128 number below 2^32."""
    steps = F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)
    return steps.cast("long")


def record_length(key: Column, value: Column) -> Column:
    """Bytes of a log record: type, two varint lengths, stored key, value, checksum."""
    klen = F.octet_length(key) + TRAILER_BYTES
    vlen = F.coalesce(F.octet_length(value), F.lit(0))
    return (F.lit(1) + varint_length(klen) + klen + varint_length(vlen) + vlen + F.lit(4)).cast("long")


def pack(seq: Column, typ: Column) -> Column:
    """Inverted sequence number and type in one 64-bit number (negative as a signed one)."""
    return F.shiftleft(F.lit(MAX_SEQ) - seq, 8).bitwiseOR(typ.cast("long"))


def unpack_seq(packed: Column) -> Column:
    return F.lit(MAX_SEQ) - F.shiftrightunsigned(packed, 8)


def unpack_type(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(255).cast("long")).cast("int")


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a string, as a long."""
    code = F.hex(key.cast("binary"))
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, 2), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(F.lit(MASK32))
    indices = F.when(F.octet_length(key) > 0, F.sequence(F.lit(0), F.octet_length(key) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indices, F.lit(FNV_SEED).cast("long"), step)


def bloom_positions(h: Column, bits: Column) -> Column:
    """Positions set for a key with hash ``h`` in a filter of ``bits`` bits, by double hashing."""
    delta = F.shiftright(h, 17) + (h % 131072) * 32768
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: (h + i * delta).bitwiseAND(F.lit(MASK32)) % bits)


def bloom_bits(n: Column) -> Column:
    """Bits of a filter for ``n`` entries: ten each, 64 at least, whole bytes."""
    return (F.floor((F.greatest(n * BITS_PER_KEY, F.lit(64)) + 7) / 8) * 8).cast("long")
