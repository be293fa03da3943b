"""Each operator against brute force on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import types as T

from tests.llm import brute
from tidemark.llm import chats, classifier, common, decontaminate, extract, lines, mixing, quality, queries, repeats, sketch, tokens

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()), T.StructField("size", T.StringType())])
LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
BASE = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    None, "", " ", "\n\n", "one", BASE, BASE, BASE.replace("word30", "changed"), BASE.upper(), LONG, LONG + " end", "\x00 zero\t\x0b\x0c\r", "日本語 テキスト " * 30,
    "a\nb\na\n" + BASE, BASE + "\n" + BASE.replace("word10", "ten"), "x" * 3000, "# $ % & | < > " * 20, "!!! " * 40, "\U0001f600 smile <s> </s> <unk> ▁", "\n".join([BASE] * 3),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, "clash", "clash", "clash") for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def named_null(spark):
    """Null ids and rows that are repeated in full."""
    return spark.createDataFrame([(None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None), (3, BASE, None, "a", None, None, None), (3, BASE, None, "a", None, None, None)], DOC)


def rows_of(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


BOTH = list(enumerate(AWKWARD))


def test_mix(spark, awkward, empty):
    def check(rows, docs):
        sizes = {i: len(brute.WORD.findall(t or "")) for i, t, _ in docs}
        names = sorted({s for *_, s in docs if s is not None}) + ([None] if any(s is None for *_, s in docs) else [])
        own = {s: sum(sizes[i] for i, _, x in docs if x == s) for s in names}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        total, target, open_ = sum(own.values()), {}, set(names)
        while open_:  # shares, capped and shared anew
            share = (total - sum(target.values())) / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * share > 3 * own[s]}
            for s in over or set(open_):
                target[s] = float(3 * own[s]) if over else weight[s] * share
            open_ -= over or set(open_)
        source = {i: s for i, _, s in docs}
        taken = dict.fromkeys(names, 0)
        for i, (size, source_size, goal, took) in rows.items():
            assert size == sizes[i] and source_size == own[source[i]] and goal == pytest.approx(target[source[i]])
            assert 0 <= took <= 3 * size
            taken[source[i]] += took
        for s in names:
            assert abs(taken[s] - target[s]) <= 33

    columns = ("size", "source_size", "target", "taken")
    check(rows_of(mixing.mix(awkward), *columns), [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in BOTH])
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(queries.op1_mix_sources(spark, SF), *columns)
    check(got, [(r["doc_id"], r["text"], r["source"]) for r in table.collect()])
    assert got == rows_of(queries.op1_mix_sources(spark, SF), *columns)
    assert rows_of(mixing.mix(table, shard_words=500), *columns[:3]) == {i: x[:3] for i, x in got.items()}
    assert mixing.mix(empty).count() == 0
    assert sorted(r["taken"] for r in mixing.mix(named_null(spark)).collect())[0] == 0


def test_quality(spark, awkward, docs, empty):
    want = {i: brute.stats(t) for i, t in BOTH}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = rows_of(quality.judge(awkward), *names)
    assert {i: x[:5] for i, x in got.items()} == want
    for n_words, _, _, _, repeated, failed, kept in got.values():
        assert failed == (n_words < 10 or 100 * repeated > 20 * n_words) and not (failed and kept)
    got = rows_of(queries.op2_quality_rules(spark, SF), *names)
    assert {i: x[:5] for i, x in got.items()} == {i: brute.stats(t) for i, t in docs}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    kept = rows_of(queries.op2_quality_rules(spark, "/root/testdata/sf0.01"), "base_failed", "kept")
    assert all(kept[i][1] for i, q in labels if q == 1 and not kept[i][0])
    assert not any(kept[i][1] for i, q in labels if q == 0)
    assert quality.judge(empty).count() == 0
    assert quality.judge(named_null(spark)).count() == 4


def test_verdict_is_not_all_must_pass(spark):
    sf = "/root/testdata/sf0.1"
    rules = quality.votes()
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").select("doc_id", "kept", *[v.alias(f"v_{n}") for n, v in rules.items()])
    rows = {r["doc_id"]: r for r in rows.collect()}
    labels = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in rows]
    conflict = [(r["kept"], q) for r, q in labels if any(r[f"v_{n}"] < 0 for n in rules) and any(r[f"v_{n}"] > 0 for n in rules)]
    assert sum(kept and q == 1 for kept, q in conflict) >= 20  # one bad vote, outweighed
    assert sum(kept == (q == 1) for kept, q in conflict) >= 0.98 * len(conflict)
    assert sum(r["kept"] == (q == 1) for r, q in labels) >= 0.998 * len(labels)


def test_estimate_learns_accuracies():
    # rules 0 and 1 find the same texts, rule 2 votes bad at random
    patterns = {(-1, -1, 1): 90, (-1, -1, -1): 10, (1, 1, 1): 800, (1, 1, -1): 100}
    start, weights = quality.estimate(patterns, 3)
    assert weights[0][1] == pytest.approx(weights[1][1]) and weights[0][1] < 2 * weights[2][1] < 0
    odds = lambda voted: start + sum(w[v < 0] for w, v in zip(weights, voted, strict=True) if v)
    assert odds((1, 1, -1)) > 0 > odds((-1, -1, 1))
    start, weights = quality.estimate({}, 2)
    assert start == pytest.approx(math.log(4)) and weights[0] == pytest.approx((math.log(0.97 / 0.6), math.log(0.03 / 0.4)))


def test_lines(spark, awkward, docs, empty):
    assert rows_of(lines.dedup_lines(awkward), "n_lines", "n_removed", "text") == brute.dedup_lines(BOTH)
    assert rows_of(queries.op3_line_dedup(spark, SF), "n_lines", "n_removed", "text") == brute.dedup_lines(docs)
    rng = random.Random(5)
    made = []
    for i in range(60):
        words = [f"t{k}" for k in range(8 + i % 3)]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["new"], [words[k], "more"]])
        other = list(rng.choice(["chapter one", "日本語のテキスト", "exactly ", "seven77"]))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(other))
            other[k : k + 1] = rng.choice(["", "ü", other[k] * 2, "\U0001f600"])
        made.append((i, "\n".join([" ".join(words[: rng.choice([7, 20])]), f"line {rng.randrange(5)}", f"x{rng.randrange(9)}", "".join(other), ""])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows_of(lines.dedup_lines(df), "n_lines", "n_removed", "text") == brute.dedup_lines(made)
    assert lines.dedup_lines(empty).count() == 0
    got = [(r["doc_id"], r["n_removed"], r["text"]) for r in lines.dedup_lines(named_null(spark)).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, BASE), (None, 0, None), (3, 1, ""), (3, 1, "")], key=str)


def test_classifier(spark, awkward, empty):
    df = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01")
    got = rows_of(df, "held_out", "score", "predicted")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    held = [(got[i][2], q) for i, q in labels if got[i][0]]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    import zlib

    for i, (held_out, score, predicted) in got.items():
        assert held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1 and predicted == int(score >= 0.5)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r["score"] - 0.5) < 1e-3 for r in classifier.score(awkward, none).collect())
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(5, None), (None, 0)], "doc_id long, quality int")
    assert min(r["score"] for r in classifier.score(awkward, one).collect()) > 0.9
    assert classifier.score(empty, one).count() == 0
    assert classifier.score(named_null(spark), one).count() == 4


def test_classifier_equals_plain_solution(spark):
    import numpy as np
    from pyspark.sql import functions as F

    sf, names, rng = "/root/testdata/sf0.01", list(classifier.features()), np.random.default_rng(7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.with_stats(docs.select("doc_id", "text")).withColumns(classifier.features()).select("doc_id", *names, F.expr(f"pmod(xxhash64({', '.join(names)}), {classifier.FOLDS})").alias("fold")).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    x = rows[names].to_numpy()
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9), -6, 6)
    slopes = rng.normal(0, 1, (len(names), classifier.COSINES)) / np.sqrt(len(names) / 2)
    z = np.c_[np.sqrt(2 / classifier.COSINES) * np.cos(z @ slopes + rng.uniform(0, 2 * np.pi, classifier.COSINES)), np.ones(len(z))]
    y = rows.doc_id.map(dict(zip(labels.doc_id, labels.quality, strict=True))).to_numpy(float)
    import zlib

    known = ~np.isnan(y) & np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in rows.doc_id])
    fit = lambda m: np.linalg.lstsq(np.r_[z[m], np.sqrt(classifier.RIDGE * m.sum()) * np.eye(z.shape[1])], np.r_[y[m], np.zeros(z.shape[1])])[0]
    fold = rows.fold.to_numpy()
    place = np.zeros(len(z))
    for f in range(classifier.FOLDS):
        place[fold == f] = z[fold == f] @ fit(known & (fold != f))
    bins = np.clip(np.floor((place + 0.5) / 2 * classifier.BINS), 0, classifier.BINS - 1)[known]
    some = np.unique(bins)
    n, s = np.array([(bins == b).sum() for b in some]), np.array([y[known][bins == b].sum() for b in some])
    mean = np.array([max(min(s[a : c + 1].sum() / n[a : c + 1].sum() for c in range(i, len(some))) for a in range(i + 1)) for i in range(len(some))])
    raw = z @ fit(known)
    level = np.interp((raw + 0.5) / 2 * classifier.BINS, np.c_[some + 0.25, some + 0.75].ravel(), np.repeat(mean, 2))
    want = np.clip((1 - 1e-4) * level + 1e-4 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -50, 50))), 0, 1)
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality_classifier(spark, sf).collect()}
    assert max(abs(got[i] - w) for i, w in zip(rows.doc_id, want, strict=True)) < 1e-3


def test_pool():
    import numpy as np

    first, last, mean = classifier.pool(np.array([2.0, 2, 0, 2, 2]), np.array([1.0, 0, 0, 2, 1]))
    assert mean.tolist() == [0.25, 0.75] and first.tolist() == [0, 3] and last.tolist() == [1, 4]


def test_tokens(spark, awkward, docs, empty):
    import sentencepiece

    path = Path(queries.tokenizer_path(queries.VOCABULARY))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    want = lambda pairs: {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in pairs}
    assert rows_of(tokens.count_tokens(awkward, path.read_bytes()), "n_bytes", "n_tokens") == want(BOTH)
    got = rows_of(queries.op5_token_counts(spark, SF), "n_bytes", "n_tokens", "over_limit")
    assert {i: x[:2] for i, x in got.items()} == want(docs)
    assert all(over == (n > 4096) for _, n, over in got.values())
    merger = tokens.Merger(path.read_bytes())
    rng = random.Random(2)
    parts = [*"abcdetion▁ ▁  é日\n\t\r/<>", "the", " of", "  ", "\U0001f600", "\x00"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["ab" * 2000, " " * 1500, "the" * 400]
    assert merger.count_texts(made).tolist() == [len(x) for x in library.encode(made)]
    assert tokens.count_tokens(empty, path.read_bytes()).count() == 0


def test_near(spark, awkward, docs, empty, monkeypatch):
    assert rows_of(sketch.find_groups(awkward, words=2), "n_shingles", "component_id") == brute.near_groups(BOTH)
    rng, made = random.Random(4), []
    for g in range(12):  # chains and stars of copies around the threshold
        words = [f"g{g}w{rng.randrange(80)}" for _ in range(90)]
        for _ in range(9):
            edited = list(words)
            for _ in range(rng.randrange(7)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(1000)}"
            made.append((len(made), " ".join(edited)))
    rng.shuffle(made)
    got = rows_of(sketch.find_groups(spark.createDataFrame(made, "doc_id long, text string"), words=2), "n_shingles", "component_id", "kept")
    want = brute.near_groups(made)
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(kept == (component == i) for i, (_, component, kept) in got.items())
    # a cluster of several groups, cut into many blocks
    words = [f"c{k}" for k in range(120)]
    chained = [(i, " ".join([*words[: 120 - 3 * (i % 12)], *[f"z{i % 12}_{k}" for k in range(i % 12)], f"u{i % 5}"])) for i in range(60)] + [(100 + i, " ".join([*words, "tail", *[f"q{i}_{k}" for k in range(i)]])) for i in range(30)]
    monkeypatch.setattr(sketch, "BLOCK_SHINGLES", 700)
    for some in (made, chained):
        got = rows_of(sketch.find_groups(spark.createDataFrame(some, "doc_id long, text string"), words=2), "n_shingles", "component_id")
        assert got == brute.near_groups(some)
    assert sketch.find_groups(empty).count() == 0
    got = [tuple(r) for r in sketch.find_groups(named_null(spark), words=2).collect()]
    assert sorted(got, key=str) == sorted([(None, 59, None, True), (None, 0, None, True), (3, 59, 3, True), (3, 59, 3, True)], key=str)


def test_near_shuffles_no_sketch_outside_clusters(spark, monkeypatch):
    rng = random.Random(7)
    made = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    made += [(100 + i, t + " end") for i, t in made[:9]] + [(200 + i, t) for i, t in made[:4]]
    df, plans, keep = spark.createDataFrame(made, "doc_id long, text string"), [], common.materialize

    def seen(table):
        if {"names", "bands", "registers"} <= set(table.columns) and "pivot" not in table.columns:
            plans.append(table._jdf.queryExecution().executedPlan().toString())
        return keep(table)

    monkeypatch.setattr(common, "materialize", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # of tables that are small by hint alone
    try:
        want = {r["doc_id"]: r["component_id"] for r in sketch.find_groups(df, words=2).collect()}
        # texts and sketches of clusters, and sketches of classes, are found by broadcast
        assert plans[0].count("BroadcastHashJoin") >= 3, plans[0]
        assert {i: c for i, (_, c) in brute.near_groups(made).items()} == want
        monkeypatch.setattr(sketch, "BROADCAST_ROWS", 6)  # clusters are dealt into parts
        assert {r["doc_id"]: r["component_id"] for r in sketch.find_groups(df, words=2).collect()} == want
        assert plans[-1].count("BroadcastHashJoin") >= 4, plans[-1]
        ids = spark.createDataFrame([(i,) for i in range(0, 20, 2)], "doc_id long")
        for broadcasts in (8, 1):  # by parts, and by shuffle
            monkeypatch.setattr(sketch, "BROADCASTS", broadcasts)
            assert sorted(r["doc_id"] for r in sketch.among(df, ids, "doc_id").collect()) == list(range(0, 20, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_registers_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, np.uint64)
    b = np.r_[a[:2700], rng.integers(0, 2**63, 300, np.uint64)]
    ra, rb = sketch.registers(a), sketch.registers(b)
    assert np.array_equal(sketch.registers(np.r_[a, b]), np.maximum(ra, rb))
    one = lambda x: np.array([float(x)])
    estimate = sketch.joint_estimate(one(3000), one(3000), one((ra > rb).sum()), one((ra < rb).sum()), one((ra == rb).sum()))[0]
    assert abs(estimate - 2700 / 3300) < 0.12


def test_repeats(spark, awkward, docs, empty):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(repeats.remove_repeats(awkward), *names) == brute.repeated_bytes(BOTH)
    assert rows_of(queries.op7_suffix_dedup(spark, SF), *names) == brute.repeated_bytes(docs)
    rng = random.Random(8)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    made = [(i, "".join(rng.choice(parts) for _ in range(6))) for i in range(40)] + [(99, "ab" * 200), (100, "ab" * 30), (101, "ba" * 40)]
    for hot, collapse in ((5000, True), (1, True), (5000, False), (1, False)):
        assert rows_of(repeats.remove_repeats(spark.createDataFrame(made, "doc_id long, text string"), hot=hot, collapse=collapse), *names) == brute.repeated_bytes(made)
    # texts of several shards, whole copies of them, and rows that are repeated in full
    long = "".join(rng.choice(parts) for _ in range(60))
    made += [(200, long), (201, long), (202, "x" + long[500:]), (203, long[:900] + "tail" + long[901:]), (201, long), (204, long[:-49])]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in made], "doc_id long, text string, kept string, shard string")
    want = brute.repeated_bytes(made)
    for keep, collapse in ((True, True), (False, True), (False, False)):
        out = repeats.remove_repeats(df, shard_bytes=300, keep=keep, collapse=collapse)
        assert rows_of(out, *names) == want and out.count() == len(made)
        assert ("kept" in out.columns) == keep
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in repeats.remove_repeats(df, shard_bytes=300).collect())
    assert repeats.remove_repeats(empty).count() == 0
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in repeats.remove_repeats(named_null(spark)).collect())
    assert got == [(-1, 0), (-1, len(BASE)), (3, 0), (3, 0)]


def test_merge_equals_one_sort():
    import numpy as np

    rng = random.Random(3)
    pieces = [(np.array([rng.randrange(9) for _ in range(5)]), [bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 30))) for _ in range(5)]) for _ in range(4)]
    seen = {}
    for ids, strings in pieces:
        for i, s in zip(ids, strings, strict=True):
            for k in range(len(s) - 5):
                seen[s[k : k + 6]] = min(seen.get(s[k : k + 6], 99), i)
    flat = [(ids, np.array([len(s) for s in strings]), np.frombuffer(b"".join(strings), np.uint8)) for ids, strings in pieces]
    for (ids, strings), found in zip(pieces, repeats.repeated_windows(flat, 6), strict=True):
        assert found.tolist() == [seen[s[k : k + 6]] < i for i, s in zip(ids, strings, strict=True) for k in range(len(s) - 5)]


def test_a_window_of_many_shards_is_ordered_once():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(6)
    common, n = rng.integers(97, 122, 50).astype(np.uint8), 20_000  # in as many shards, beside strings of one window and of more
    pieces = [(np.arange(a + 5, a + 5 + 1000), np.full(1000, 50), np.tile(common, 1000)) for a in range(0, n, 1000)]
    other = rng.integers(97, 122, 80).astype(np.uint8)
    pieces.append((np.array([9, 9, 7, 3, 8]), np.array([50, 50, 80, 51, 50]), np.concatenate([other[:50], common, other, np.r_[common, other[:1]], other[:50]])))
    pieces.append((np.array([5, 3]), np.array([50, 50]), np.tile(common, 2)))
    tracemalloc.start()
    found = repeats.repeated_windows(pieces, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(hits.all() for hits in found[:-2])  # document 3 has it first
    assert found[-2].tolist() == [True, True] + [False] * 31 + [False, False] + [True]
    assert found[-1].tolist() == [True, False]
    assert peak < 20 << 20, peak


def test_marks_and_wide_alphabets():
    import numpy as np

    rng = np.random.default_rng(5)
    for bits in (1, 2):
        counts = rng.integers(0, 20, 30)
        values = rng.integers(0, 1 << bits, counts.sum()).astype(np.uint8)
        data, sizes = repeats._bytes(repeats._packed(values, counts, bits))
        assert sizes.tolist() == (-(-counts * bits // 8)).tolist()
        assert np.array_equal(repeats._unpacked(data, counts, bits), values)
    with pytest.raises(ValueError):
        repeats._unpacked(data[1:], counts, bits)
    for size in (300, 1 << 16, 200_000):
        letters = rng.integers(0, size, 5000).astype(np.int32)
        assert np.array_equal(repeats._by(letters, size), np.argsort(letters, kind="stable"))
    # strings without a common alphabet, in two pieces of more than 65,536 letters
    flat = [(np.arange(k, k + 900), np.full(900, 60), rng.integers(0, 250, 54_000).astype(np.uint8)) for k in (0, 900)]
    flat[1][2][:60] = flat[0][2][60:120]
    found = repeats.repeated_windows(flat, 50)
    assert not found[0].any() and found[1][:11].all() and not found[1][11:].any()


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><nav><ul><li><a href=x>Menu</a></ul></nav><div class=ad>Buy</div><div id='cookie-notice'>Cookies</div><article><h1>Head &amp; more</h1><p>One <b>two<br>three</b>\n four<p>{0}<ul><li>x<li>y</ul><form><input>Send</form></article><div class=comments><p>Nice!</p></div><aside>Side</aside><footer>&copy; {1}</footer></body>"


def test_extract(spark):
    rows = [(i, "http://h.example/x", PAGE.format("Same text." if i % 2 else f"Text {i} &lt;", i)) for i in range(12)]
    rows += [(50, None, None), (51, "http://h.example/y", ""), (52, "bad url", "plain"), (53, "http://z.example", "<article><p>cut off"), (54, "http://z.example", "<p>no article<script>x()</script> here</p><div>tail"), (55, "http://z.example", "<article>a &nbsp; b<!-- c --></article>"), (0, rows[0][1], rows[0][2])]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(12):
        assert text[i] == f"Head & more\n\nOne two three four\n\n{'Same text.' if i % 2 else f'Text {i} <'}\n\nx\n\ny"
    assert [text[i] for i in (50, 51, 52, 53, 54, 55)] == ["", "", "plain", "cut off", "no article here\n\ntail", "a b"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    table = {r["page_id"]: r["text"] for r in queries.op8_html_extract(spark, SF).collect()}
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert table[r["page_id"]] == "\n\n".join(b for b in blocks if b)
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, sources):
    df = spark.createDataFrame([(i, "http://t.example/x", s) for i, s in enumerate(sources)], "page_id long, url string, html string")
    return [r["text"] for r in extract.extract(df).orderBy("page_id").collect()]


def test_extract_drops_unlabelled_text_that_a_host_shares(spark):
    page = "<body><div><p>Our <b>shop</b> opens at nine.</p></div><div><h2>Title {0}</h2><p>Body {0}, first.<p>Body {0}, second.</div><div class=header><h1>Head {0}</h1>Call us</div><div class=ad>Buy {1}</div><p>All rights kept.</body>"
    made = [page.format(i, "this" if i % 2 else "that") for i in range(8)]
    want = [f"Title {i}\n\nBody {i}, first.\n\nBody {i}, second.\n\nHead {i}" for i in range(8)]
    assert extracted(spark, made) == want
    # copies of a page are no evidence, nor are two pages
    assert set(extracted(spark, made[:1] * 8)) == {"Our shop opens at nine.\n\nTitle 0\n\nBody 0, first.\n\nBody 0, second.\n\nAll rights kept."}
    assert extracted(spark, made[:2])[1].startswith("Our shop opens at nine.")


def test_extract_keeps_unique_text_under_hinting_names(spark):
    parts = ["<section id='search-trees'><p>Trees {0}</section>", "<div class='alert-box'>Box {0}</div>", "<div class='article-header'><h1>One {0}</h1></div>", "<header><h1>Two {0}</h1></header>", "<aside>Aside {0}</aside>", "<div id='reply-to-critics'>Reply {0}</div>", "<p>See <span class='social-theory'>theory {0}</span>, too"]
    shared = "<div class=share>Share <a>this</a></div><p class=notice>We use cookies</p>"
    barred = "<nav>Go {0}</nav><form>Send {0}</form><div class='comment-list'>Comment {0}</div>"
    page = "<body><article><p>Text {0}" + "".join(parts) + shared + barred + "</article><p>Outside {0}</body>"
    want = [f"Text {i}\n\nTrees {i}\n\nBox {i}\n\nOne {i}\n\nTwo {i}\n\nAside {i}\n\nReply {i}\n\nSee theory {i}, too" for i in range(6)]
    assert extracted(spark, [page.format(i) for i in range(6)]) == want
    # on one page of many
    plain = "<body><article><p>Text {0}" + shared + "</article></body>"
    assert extracted(spark, [plain.format(i) for i in range(6)] + [page.format(9)])[-1] == want[0].replace("0", "9")
    # adverts that rotate recur
    rotating = "<body><article><p>Text {0}<div class=ad>Buy {1}</div></article></body>"
    assert extracted(spark, [rotating.format(i, i % 4) for i in range(12)]) == [f"Text {i}" for i in range(12)]


def test_deduce_classes_are_ordered_and_nest():
    up = lambda r: 0
    assert extract.deduce([[2, 4, -1, 5, 3]] * 3, up) == {2, 3, 4, 5, -1}
    assert extract.deduce([[2, 4, 5, 3]] * 2, up) == set()
    # one order on each page, or the elements are no class; shared texts stay classes of their own
    assert extract.deduce([[2, 4, -1], [4, 2, -1], [2, 4, -1]], up) == {-1}
    # (4, 5) comes once more than (2, 3) on a page and is cut through by it
    assert extract.deduce([[2, 4, 3, 5], [2, 4, 3, 5], [2, 4, 3, 5, 4, 5]], up) == {2, 3}


def test_contamination(spark, awkward, docs, empty):
    items = [(1, BASE[:200]), (2, "one"), (3, None), (4, "!!"), (None, "ten word11"), (1, "zero"), (5, "テキスト 日本語 テキスト"), (12, "WORD0 word1 Word2")]
    df = spark.createDataFrame(items, "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256")
    want = brute.contamination(BOTH, [("null" if i is None else i, t) for i, t in items])
    found = decontaminate.find_contamination(awkward, df)
    assert rows_of(found, *names) == want
    assert rows_of(decontaminate.find_contamination(awkward, df, max_block_bytes=64), *names) == want
    for r in found.where("n_hit > 0").collect():
        assert sum(len(brute.ITEM_WORD.findall(r["text"][s["start"] : s["end"]].translate(brute.LOWER))) for s in r["spans"]) == r["n_hit"]
    table = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(queries.op9_decontaminate(spark, SF), *names) == brute.contamination(docs, table)
    assert decontaminate.find_contamination(empty, df).count() == 0
    rng = random.Random(6)
    phrase = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    texts, tests = [(i, phrase(rng.randrange(300))) for i in range(40)], [(i, phrase(rng.choice([1, 3, 5, 6, 9, 10, 11, 14, 40]))) for i in range(60)]
    found = decontaminate.find_contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string"))
    assert rows_of(found, *names) == brute.contamination(texts, tests)
    twice = decontaminate.find_contamination(named_null(spark), spark.createDataFrame([(1, BASE)], "item_id long, text string"))
    assert sorted((r["doc_id"] or -1, r["n_hit"]) for r in twice.collect()) == [(-1, 0), (-1, 60), (3, 60), (3, 60)]
    nothing = decontaminate.find_contamination(awkward, df.limit(0)).collect()
    assert {r["items_sha256"] for r in nothing} == {hashlib.sha256(b"").hexdigest()}


def test_index_of_a_large_benchmark_stays_small():
    """4 MB of items: what a worker builds takes less than 30 bytes a byte, so a block of 8 MB takes less than 250 MB."""
    import subprocess
    import sys

    code = """
import random, resource
from tidemark.llm import decontaminate as D
rng = random.Random(1)
words = [f"w{rng.randrange(10**7)}" for _ in range(60_000)]
rows, size = [], 0
while size < 4 << 20:
    rows.append((str(len(rows)), " ".join(rng.choice(words) for _ in range(60))))
    size += len(rows[-1][1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = D.Index(D.Items.of(rows), 10)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / size)
text = D.folded_words("x " + rows[7][1] + " y")
assert index.find(text)[2] == {"7"} and len(index.find(text)[0]) == 51
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(got.stdout.split()[-1]) < 30


def test_chats(spark):
    def render(turns):
        return "".join(f"<|im_start|>{(r or '')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in turns)

    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = {r["conv_id"]: r["text"] for r in queries.op10_chat_format(spark, SF).collect()}
    assert got == {c: render(x) for c, x in brute.maximal_chats(rows).items()}
    made = [(1, t, "user", f"t{t}") for t in range(5)] + [(2, t, "user", f"t{t}") for t in range(9)] + [(3, t * 10, "user", f"t{t}") for t in range(9)] + [(4, 0, "user", "t0"), (4, 1, None, "<|x"), (4, 1, None, "<|x"), (5, 0, "user", None)]
    schema = "conv_id long, turn long, role string, text string"
    for block, part in ((256, 256), (2, 3)):
        out = chats.render(spark.createDataFrame(made, schema), block_turns=block, part_turns=part).orderBy("conv_id", "part").collect()
        text = {}
        for r in out:
            text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
        assert text == {c: render(x) for c, x in brute.maximal_chats(made).items()}
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x")], schema)
    assert [r["text"] for r in chats.render(odd).collect()] == [render([(None, None), ("user", "x")])]
    assert chats.render(odd.limit(0)).count() == 0
