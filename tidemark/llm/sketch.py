"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct word shingles, named by 64 bits. Documents with equal sets form a class,
represented by its smallest doc_id. Each representative gets a SetSketch: register j is
floor(1 - log_b of the smallest of exponential values that hash j gives to the shingles), truncated to a range;
registers of unions are the maxima of registers, and two sets agree in a register with a probability close to
their similarity. Then:

1. Bands of registers that agree make candidates. Nodes that share band values, directly or through others, form
   a cluster; clusters come from star edges to the smallest member of each band value, so no pairs arise in Spark.
2. The joint likelihood of the registers (how many are greater, smaller and equal, given both set sizes) drops pairs that
   are certain to be too far apart. The rest are confirmed on the full sets, by integers: 100 * intersection >=
   similarity * union.
3. Every node of a cluster is held against the cluster's smallest node, and what is not linked with it against the
   smallest of what is left. So a group of copies of any size is settled row by row: its nodes are connected. What is
   left is cut into blocks of about ``BLOCK_SHINGLES`` shingles, and so is what is connected. Pairs of blocks, but those that
   are connected already, are groups of rows; in a group, pairs that agree in a band and are not yet connected are
   looked at, and the links of a spanning forest come out.
4. Confirmed links make components by contraction.

The work on a cluster is its size times the number of blocks of nodes that its two groups of copies don't hold.

A pair at similarity 0.8 agrees in none of the 48 bands of 6 registers with a probability below 1e-6.

Defined cases: texts without words, empty and null ones have n_shingles 0 and are linked with nothing; rows with
the same doc_id are one document; very long texts make one set; rows with a null doc_id are linked with nothing, have a null component and are
kept; columns of the input that clash with the added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Steps, discard, map_batches, materialize, small, texts_of, workers

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
BASE, LIMIT = 1.02, 2000
#: Shingles of a block: 8 bytes each in memory.
BLOCK_SHINGLES = 1 << 18
#: Nodes of a cluster that the others are held against before blocks are compared.
PIVOTS = 2
#: Rounds of contraction, each of which removes a constant share of the nodes, before an error is raised.
ROUNDS = 200
#: Rows up to which a counted table of ids is broadcast.
BROADCAST_ROWS = 1_000_000
#: Tables of so many rows that ids are broadcast in, before the rows that are looked for are shuffled.
BROADCASTS = 8
_U = np.uint64
_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FACTORS = np.random.default_rng(11).integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.random.default_rng(12).integers(0, 1 << 32, REGISTERS, np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def place_factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def word_names(data: np.ndarray) -> np.ndarray:
    """64-bit names of the words (runs of bytes other than white space) of a text."""
    inside = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, _U)
    letters = data[inside].astype(_U) + _U(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mixed(np.add.reduceat(letters * place_factors(int(lengths.max()))[place], first) + lengths.astype(_U))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle names; with fewer words, the whole sequence is one."""
    names = word_names(np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8))
    if not len(names):
        return names
    out = np.zeros(max(1, len(names) - words + 1), _U)
    for k in range(min(words, len(names))):
        out = mixed(out * _U(31) + names[k : k + len(out)] + _U(k + 1))
    return np.unique(out)


def registers(names: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set."""
    low = (names >> _U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        x = (low[at : at + 256, None] ^ _SHIFTS) * _FACTORS
        np.minimum(least, x.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 1) / (2.0**32 + 1))
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), -LIMIT, LIMIT).astype(np.int16)


def joint_estimate(n1: np.ndarray, n2: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from the register comparison counts of sets of known sizes, on a grid."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = np.clip(1 - up - down, 1e-12, None)
    likelihood = above[:, None] * np.log(np.clip(up, 1e-12, None)) + below[:, None] * np.log(np.clip(down, 1e-12, None)) + equal[:, None] * np.log(same)
    return j[np.arange(len(j)), likelihood.argmax(axis=1)]


def _set_name(names: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mixed(names).sum(dtype=_U).astype(np.int64)), int(mixed(names ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).astype(np.int64))


def _sketched(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """doc_id, h1 and h2 (name of the set), n_shingles, bands, registers."""

    def make():
        factors = place_factors(REGISTERS).reshape(BANDS, ROWS)
        numbers = np.arange(BANDS, dtype=_U)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            h1, h2, sizes, bands, regs = [], [], [], [], []
            for t in texts_of(batch, "text"):
                names = shingles(t, words)
                sizes.append(len(names))
                for out, part in zip((h1, h2), _set_name(names), strict=True):
                    out.append(part)
                own = registers(names) if len(names) else None
                regs.append(None if own is None else own.tobytes())
                grid = None if own is None else (own.astype(np.int64) + 4096).astype(_U).reshape(BANDS, ROWS)
                bands.append(None if own is None else mixed(mixed((grid * factors).sum(axis=1, dtype=_U)) + numbers).view(np.int64))
            return [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())]

        return work

    long = T.LongType()
    added = [T.StructField("h1", long), T.StructField("h2", long), T.StructField("n_shingles", long), T.StructField("bands", T.ArrayType(long)), T.StructField("registers", T.BinaryType())]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, added, ["doc_id"])


def _links(group: pa.Table, similarity: int) -> pa.Table:
    """Confirmed links between the two blocks of a group (or within its only block): a spanning forest."""
    node = group.column("node").to_numpy()
    left = group.column("side").to_numpy() == 0
    one = bool(left.all())
    n = group.column("n_shingles").to_numpy().astype(np.float64)
    bands = np.array([x.as_py() for x in group.column("bands")], np.int64).reshape(-1, BANDS)
    regs = np.frombuffer(b"".join(x.as_py() for x in group.column("registers")), np.int16).reshape(-1, REGISTERS)
    names = np.concatenate([np.frombuffer(x.as_py(), _U) for x in group.column("names")])
    _, ids = np.unique(names, return_inverse=True)
    starts = np.r_[0, np.cumsum(n.astype(np.int64))]
    flag = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    least = similarity / 100 - 7 * math.sqrt(similarity / 100 * (1 - similarity / 100) / REGISTERS)
    label = group.column("label").to_numpy()
    root = np.arange(len(node))
    for connected in range(PIVOTS):
        if len(known := np.flatnonzero(label == connected)):
            root[known] = known[0]
    others = np.arange(len(node)) if one else np.flatnonzero(~left)
    a_out, b_out = [], []
    for a in np.arange(len(node)) if one else np.flatnonzero(left):
        b = others[others > a] if one else others
        b = b[root[b] != root[a]]
        b = b[np.minimum(n[b], n[a]) * 100 >= np.maximum(n[b], n[a]) * similarity]
        b = b[(bands[b] == bands[a]).any(axis=1)]
        if len(b):
            estimate = joint_estimate(np.full(len(b), n[a]), n[b], (regs[b] < regs[a]).sum(axis=1), (regs[b] > regs[a]).sum(axis=1), (regs[b] == regs[a]).sum(axis=1))
            b = b[estimate >= least]
        if not len(b):
            continue
        flag[ids[starts[a] : starts[a + 1]]] = True
        for q in b:
            if root[q] != root[a]:
                both = int(flag[ids[starts[q] : starts[q + 1]]].sum())
                if 100 * both >= similarity * (int(n[a]) + int(n[q]) - both):
                    a_out.append(node[a])
                    b_out.append(node[q])
                    root[root == root[q]] = root[a]
        flag[ids[starts[a] : starts[a + 1]]] = False
    return pa.table([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _against(rows: DataFrame, similarity: int) -> DataFrame:
    """``rows`` with linked: whether a node is linked with the smallest node of its component's rows, or is that row."""
    fields = ["n_shingles", "registers", "names", "h1"]
    least = rows.groupBy("component").agg(F.min(F.struct("node", "h1")).alias("least")).select("component", "least.*")
    pivots = rows.join(least, ["component", "node", "h1"]).select("component", F.col("node").alias("pivot"), *[F.col(f).alias(f"p_{f}") for f in fields])
    floor = similarity / 100 - 7 * math.sqrt(similarity / 100 * (1 - similarity / 100) / REGISTERS)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            own, theirs = (get(c).to_numpy().astype(np.float64) for c in ("n_shingles", "p_n_shingles"))
            regs, p_regs = (np.frombuffer(b"".join(x.as_py() for x in get(c)), np.int16).reshape(-1, REGISTERS) for c in ("registers", "p_registers"))
            linked = (get("node").to_numpy() == get("pivot").to_numpy()) & (get("h1").to_numpy() == get("p_h1").to_numpy())
            may = np.flatnonzero(~linked & (np.minimum(own, theirs) * 100 >= np.maximum(own, theirs) * similarity))
            if len(may):
                x, y = regs[may], p_regs[may]
                estimate = joint_estimate(own[may], theirs[may], (x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1))
                for k in may[estimate >= floor].tolist():
                    a, b = (np.frombuffer(get(c)[k].as_buffer(), _U) for c in ("names", "p_names"))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    linked[k] = 100 * both >= similarity * (len(a) + len(b) - both)
            return [pa.array(linked)]

        return work

    return map_batches(rows.join(pivots, "component"), make, [T.StructField("linked", T.BooleanType())], [*rows.columns, "pivot"])


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in the materialized table ``ids``. None is shuffled: beyond ``BROADCAST_ROWS`` the ids are dealt
    into parts, each broadcast and held against all rows, and only beyond ``BROADCASTS`` parts it is a join by shuffle."""
    parts = -(-ids.count() // BROADCAST_ROWS)
    if parts > BROADCASTS:
        return rows.join(ids, key, "left_semi")
    part = F.pmod(F.xxhash64(key), F.lit(max(1, parts)))
    found = [rows.join(F.broadcast(ids.where(part == k) if parts > 1 else ids), key, "left_semi") for k in range(max(1, parts))]
    return functools.reduce(DataFrame.unionByName, found)


def _confirmed(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, doc_id: str, words: int, similarity: float, step: Steps) -> DataFrame:
    """Links (a, b) within clusters, of whose nodes ``nodes`` has the rows."""
    own = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    own = among(own, clusters.select("node"), "node")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = list(texts_of(batch, "text"))
            sets = [shingles(t, words) for t in texts]
            return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_set_name(s)[0] for s in sets], pa.int64())]

        return work

    limit = round(similarity * 100)
    fields = [T.StructField("names", T.BinaryType()), T.StructField("h1", T.LongType())]
    sets = map_batches(own, make, fields, ["node"]).dropDuplicates(["node", "h1"])
    rows = step(small(clusters, BROADCAST_ROWS).join(nodes, "node").join(sets, ["node", "h1"]))
    columns, links, labelled = rows.columns, [], []
    for label in range(PIVOTS):
        held = step(_against(rows, limit))
        links.append(held.where("linked and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        labelled.append(held.where("linked").select(*columns, F.lit(label).alias("label")))
        rows = held.where("not linked").select(*columns)
    labelled.append(rows.withColumn("label", F.lit(PIVOTS)))
    rows = labelled[0]
    for part in labelled[1:]:
        rows = rows.unionByName(part)

    # blocks are numbered label by label; a block that is connected in itself meets those of other labels only
    sums = rows.groupBy("component", "label").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("n"))
    counts = sums.groupBy("component").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(PIVOTS + 1)])
    groups = sum((F.col(f"n{k}") > 0).cast("int") for k in range(PIVOTS))
    counts = step(counts.where((F.col(f"n{PIVOTS}") > 0) | (groups > 1)))
    begins, end = [], F.lit(0).cast("long")
    for k in range(PIVOTS + 1):
        begins.append(end)
        end = end + F.col(f"n{k}")
    span = lambda low, high: F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    none = F.lit(None)
    block, others = none, none
    for k in range(PIVOTS + 1):
        after = begins[k] + F.col(f"n{k}")
        here = F.col("label") == k
        block = F.when(here, begins[k] + F.pmod(F.xxhash64("node"), F.col(f"n{k}"))).otherwise(block)
        others = F.when(here, span(F.lit(0).cast("long"), end) if k == PIVOTS else F.concat(span(F.lit(0).cast("long"), begins[k]), span(after, end))).otherwise(others)
    rows = rows.join(small(counts, BROADCAST_ROWS), "component").withColumn("block", block).withColumn("other", F.explode(others))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": F.when(F.col("block") <= F.col("other"), 0).otherwise(1)})
    found = workers(rows.select("component", "i", "j", "side", "node", "label", "n_shingles", "bands", "registers", "names")).groupBy("component", "i", "j").applyInArrow(lambda group: _links(group, limit), "a bigint, b bigint")
    found = step(found)
    for part in links:
        found = found.unionByName(part)
    return found


def components(links: DataFrame, step: Steps) -> DataFrame:
    """(node, component) of the nodes that have links: the smallest node that can be reached.

    In each round every node joins the neighbour of least priority (or stays), and the links are rewritten between
    what the nodes have become; equal links and loops fall away, so rounds shrink by a constant factor. The
    priority is the node itself at first, which settles stars at once, then a hash.
    """
    edges = step(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    became = None
    for turn in itertools.count():
        if turn == ROUNDS:
            raise RuntimeError(f"components are not found after {ROUNDS} rounds")
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, turn=turn: F.xxhash64(F.lit(turn), F.col(c)))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        best = F.least(F.struct(rank("a").alias("r"), F.col("a").alias("to")), F.struct(rank("b").alias("r"), F.col("b").alias("to")))
        joins = step(both.groupBy(F.col("a").alias("node")).agg(F.min(best).alias("best")).select("node", F.col("best.to").alias("to")))
        if turn == 0:
            became = joins
        elif not joins.limit(1).count():
            break
        else:
            moved = joins.select(F.col("node").alias("to"), F.col("to").alias("next"))
            became = step(became.join(moved, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        end = lambda k: joins.select(F.col("node").alias(k), F.col("to").alias(f"new_{k}"))
        moved = edges.join(end("a"), "a").join(end("b"), "b").where("new_a <> new_b")
        edges = step(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
    least = became.groupBy("to").agg(F.min("node").alias("component"))
    return step(became.join(least, "to").select("node", "component"))


def find_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``, a table in the shared folder."""
    step = Steps()
    rows = step(_sketched(docs, text, doc_id, words))
    classes = step(rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    # a doc_id on rows with different texts is one document: its rows are linked by their common node
    known, named = small(classes, BROADCAST_ROWS), rows.withColumnRenamed("doc_id", "node")
    nodes = named.join(known, ["node", "h1", "h2"], "left_semi")
    members = nodes.select("node", F.explode("bands").alias("band"))
    shared = step(members.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("band", "a"))
    stars = members.join(small(shared, BROADCAST_ROWS), "band").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    clusters = components(stars, step)
    # sketches are wide, and most are of no cluster
    clustered = among(named, clusters.select("node"), "node").join(known, ["node", "h1", "h2"], "left_semi")
    links = _confirmed(clusters, clustered, docs, text, doc_id, words, similarity, step)
    same_id = rows.where("n_shingles > 0").join(classes, ["h1", "h2"]).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    same_id = same_id.join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b").distinct()
    found = components(links.union(same_id), step)

    named = classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "h1", "h2", "n_shingles").join(named, ["h1", "h2"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")))
    step.clear()
    return out


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` less the documents that are not the first of their component."""
    groups = find_groups(docs, text=text, doc_id=doc_id, words=words, similarity=similarity)
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    discard(groups)
    return docs.join(small(gone, BROADCAST_ROWS), docs[doc_id] == F.col("__gone"), "left_anti")
