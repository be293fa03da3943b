"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an equal line stands earlier in the corpus, or one that is an edit away: a unit put in, left out or
replaced. Units are words (what single spaces part) if either line has ``units`` words or more, else characters, of which
either line must have ``units`` or more; so one edit changes an eighth of the longer line at most, and a line in a
script without spaces has its bound too. Order is by (doc_id, hash of the text, line number); of each distinct line its
first place counts. Lines without a word always stay.

1. Lines are cut from the texts once and written as a narrow table of hashes. Equal lines meet in an
   aggregate that keeps the first place.
2. Two lines within one edit share their first or last half, so a line joins the neighbourhood search only if a
   half of it occurs in another distinct line. This drops no pair.
3. For those lines, every variant with one unit deleted is a key: the exclusive-or of hashes of (position,
   unit), so that running window aggregates give all variants of a line in linear time. Replacements meet in
   keys with the deleted position; insertions meet a variant of the longer line with the whole shorter line.
4. Lines of a key are compared with the earliest place of the key only, which decides for all of them, so no
   pairs within a group arise. The edit distance to that line is verified on the units.
5. The first places that stay are gathered by document and the texts are put together again.

Whether a line goes does not depend on whether the earlier line itself stays.

Defined cases: null texts stay null and have no lines; rows with equal doc_id and text share places and get
the same result; very long texts are cut whole; a null doc_id is ordered first; columns of the input that clash with the added ones are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, discard, let, materialize, small, without

ADDED = ("n_lines", "n_removed")


def _named(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Lines that hold a word, with their places."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return rows.where(F.col("line").rlike(WORD)).select("id", "text_hash", "no", "line", *_named(F.col("line")))


#: How a line is cut into units.
WORDS, CHARACTERS = 0, 1


def _units(unit: Column, line: Column) -> Column:
    return F.when(unit == WORDS, F.split(line, " ")).otherwise(F.split(line, ""))


def _halves(line: Column, n: Column, unit: int) -> Column:
    """Hashes of the halves that any line within one edit shares one of."""
    ends = lambda tag, k, part: F.xxhash64(F.lit(unit), F.lit(tag), k, part)
    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    if unit == WORDS:
        after = lambda k: F.call_function("substring_index", line, F.lit(" "), -k)
        before = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    else:
        after = lambda k: F.substring(line, n - k + 1, k)
        before = lambda k: F.substring(line, F.lit(1), k)
    top = F.ceil((n + 1) / 2).cast("int")
    return F.array_distinct(F.array(ends(0, low, before(low)), ends(0, high, before(high)), ends(1, high, after(high)), ends(1, top, after(top))))


def _searched(line: Column, words: Column, units: int) -> dict[int, tuple[Column, Column]]:
    """Of each kind of unit, how many a line has, and whether the line is searched by it: also with one less than
    ``units``, as the other line may have one more."""
    chars = F.char_length(line)
    return {WORDS: (words, words >= units - 1), CHARACTERS: (chars, (words < units) & (chars >= units - 1))}


def _suspects(narrow: DataFrame) -> DataFrame:
    """(h1, h2, first) of distinct lines of which another distinct line shares a half."""
    keys = narrow.select("h1", "h2", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a != b").select("half")
    shared = materialize(shared)
    own = keys.join(small(shared, 500_000), "half", "left_semi").select("h1", "h2").distinct()
    return own


def _variants(lines: DataFrame, units: int) -> DataFrame:
    """Keys of the deletion neighbourhood: kind 0 replaces, kind 1 inserts or deletes; whole marks full lines. A line of
    fewer than ``units`` units has the whole line only."""
    words = lines.select("h1", "h2", "unit", "first", "n", F.posexplode(_units(F.col("unit"), F.col("line"))).alias("i", "w"))
    words = words.withColumn("here", F.xxhash64("w", "i")).withColumn("moved", F.xxhash64("w", F.col("i") - 1))
    line = Window.partitionBy("h1", "h2", "unit")
    upto = line.orderBy("i")
    before = F.coalesce(F.bit_xor("here").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    words = words.select("h1", "h2", "unit", "first", "n", "i", before.alias("before"), "here", after.alias("after"))
    variant, whole = F.col("before").bitwiseXOR(F.col("after")), F.col("before").bitwiseXOR(F.col("here"))
    entry = lambda kind, size, at, key, full: F.struct(F.lit(kind).alias("kind"), size.alias("size"), at.alias("at"), key.alias("key"), F.lit(full).alias("whole"))
    none = F.lit(-1)
    made = F.array(entry(0, F.col("n"), F.col("i"), variant, False), entry(1, F.col("n") - 1, none, variant, False))
    last = F.array(entry(1, F.col("n"), none, whole, True))
    at_end, long = F.col("i") == F.col("n") - 1, F.col("n") >= units
    made = F.when(long & at_end, F.concat(made, last)).when(long, made).when(at_end, last)
    return words.select("h1", "h2", "unit", "first", F.explode(made).alias("e")).select("h1", "h2", "unit", "first", "e.*")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of units are within one edit."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))

    def verdict(at: Column) -> Column:
        rest = lambda x, k: F.slice(x, F.greatest(at, F.lit(1)).cast("int") + k, F.size(x))
        size = F.size(a) - F.size(b)
        return (at == 0) | F.when(size == 0, rest(a, 1) == rest(b, 1)).when(size == 1, rest(a, 1) == rest(b, 0)).when(size == -1, rest(a, 0) == rest(b, 1)).otherwise(False)

    return let(F.array_position(differ, True), verdict)


def near_lines(narrow: DataFrame, docs: DataFrame, text: str, doc_id: str, firsts: DataFrame, units: int) -> DataFrame:
    """(h1, h2) of distinct lines that an earlier line is within one edit of."""
    suspects = materialize(firsts.join(small(materialize(_suspects(narrow)), 500_000), ["h1", "h2"], "left_semi"))
    at_first = suspects.select("h1", "h2", F.col("first.*"), "first").withColumnsRenamed({"id": "i", "text_hash": "t", "no": "l"})
    at_first = small(at_first.select("i", "t", "l", "h1", "h2", "first"), 500_000)
    rows = _lines(docs, text, doc_id).drop("h1", "h2")
    here = rows.id.eqNullSafe(at_first.i) & (rows.text_hash == at_first.t) & (rows.no == at_first.l)
    lines = rows.join(at_first, here).select("h1", "h2", "first", "line").dropDuplicates(["h1", "h2"])
    kinds = [F.when(fits, F.struct(F.lit(unit).alias("unit"), n.alias("n"))) for unit, (n, fits) in _searched(F.col("line"), F.size(F.split("line", " ")), units).items()]
    lines = materialize(lines.select("h1", "h2", "first", "line", F.explode(F.array_compact(F.array(*kinds))).alias("k")).select("h1", "h2", "first", "line", "k.unit", "k.n"))
    keys = materialize(_variants(lines, units))
    of_key = ["unit", "kind", "size", "at", "key"]
    least = lambda cond: F.min(F.when(cond, F.col("first")))
    groups = keys.groupBy(*of_key).agg(least(F.col("whole")).alias("whole_first"), least(~F.col("whole")).alias("variant_first"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    groups = small(materialize(groups), 500_000)
    rival = F.when(F.col("kind") == 0, F.col("variant_first")).when(F.col("whole"), F.col("variant_first")).otherwise(F.col("whole_first"))
    met = keys.join(groups, of_key).withColumn("rival", rival).where(F.col("rival") < F.col("first")).select("h1", "h2", "unit", "rival").distinct()
    own, theirs = (_units(F.col("unit"), F.col(c)) for c in ("line", "theirs"))
    b = lines.select("unit", F.col("first").alias("rival"), F.col("line").alias("theirs"))
    sure = met.join(lines.select("h1", "h2", "unit", "line"), ["h1", "h2", "unit"]).join(b, ["unit", "rival"]).where(_one_edit(own, theirs))
    out = materialize(sure.select("h1", "h2").distinct())
    for step in (suspects, lines, keys):
        discard(step)
    return out


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", units: int = 8) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, n_lines (those with a word) and n_removed."""
    narrow = _lines(docs, text, doc_id).withColumn("n", F.size(F.split("line", " ")))
    none = F.array().cast("array<bigint>")
    halves = F.concat(*[F.when(fits, _halves(F.col("line"), n, unit)).otherwise(none) for unit, (n, fits) in _searched(F.col("line"), F.col("n"), units).items()])
    narrow = materialize(narrow.select("id", "text_hash", "no", "h1", "h2", halves.alias("halves")))
    firsts = materialize(narrow.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash", "no")).alias("first")))
    near = small(near_lines(narrow, docs, text, doc_id, firsts, units), 500_000)
    discard(narrow)
    kept = firsts.join(near, ["h1", "h2"], "left_anti").groupBy(F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash")).agg(F.sort_array(F.collect_list("first.no")).alias("__kept"))
    out = without(docs, *ADDED).withColumn("__own", F.xxhash64(text))
    out = out.join(kept, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")

    def flags(k: Column) -> Column:
        gap = lambda x, i: x - F.coalesce(F.get(k, i - 1), F.lit(-1)) - 1
        return F.flatten(F.transform(k, lambda x, i: F.concat(F.array_repeat(F.lit(False), F.when(i == 0, x).otherwise(gap(x, F.greatest(i, F.lit(1))))), F.array(F.lit(True)))))

    kept_lines = F.coalesce("__kept", F.array().cast("array<int>"))
    out = out.withColumn("__flags", let(kept_lines, flags)).withColumn("__lines", F.split(text, "\n"))
    stays = let(F.col("__flags"), lambda f: F.filter("__lines", lambda x, i: F.coalesce(F.get(f, i), F.lit(False)) | ~x.rlike(WORD)))
    out = out.withColumn("n_lines", F.coalesce(F.size(F.filter("__lines", lambda x: x.rlike(WORD))), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.coalesce(F.size("__kept"), F.lit(0))).cast("long"))
    out = out.withColumn(text, F.when(F.col("n_removed") == 0, F.col(text)).otherwise(F.array_join(stays, "\n")))
    names = without(docs, *ADDED).columns
    return out.select(*[F.col(f"`{c}`") for c in names], *ADDED)
