"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Every document of a source has the same expected number of copies, e = target / size of the source.
floor(e) copies are certain; the fraction p is rounded jointly: two documents with fractional p are
paired and words are moved from one to the other, in a random direction whose chances keep both
expectations, until one p is 0 or 1. Moving words rather than chances keeps a source's expected words
exact at every step. Documents are dealt into leaves of about ``LEAF``; a leaf leaves at most one
undecided document, the undecided ones of ``LEAF`` leaves meet in the next level, and so on: a tree
whose depth is the logarithm of the largest source. At its root one document a source is rounded by lot, with
its fraction for a chance, so that its expectation stays. So that this is a small one, documents over 1/8, 1/64 and 1/512 of their source (at
most 8, 64 and 512 of each) are rounded before, and the classes below make up for what they take or leave: with
enough small documents a source misses its target by less than 1/1024 of its size.

A hot source has proportionally more leaves, so no task holds more than a few leaves of it. The text
is read once, to count words.

Defined results: null text has no words; sources are weighed 1, 2, 3, repeating in code point order with
null last; a target stops at ``cap`` times its source and the excess goes to the others by weight.
Rows that repeat doc_id, source and size share one decision, and so do those of one source and size without doc_id. A document
without words takes none. Randomness
is a hash of (seed, doc_id), so reruns agree. An empty table gives an empty result. Further columns, whatever their names, are
carried along by ``mixed_documents``, which moves no text, and ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillet.llm.common import WORD, staged
from quillet.llm.places import Places

LEAF = 128
#: Documents over these shares of their source are rounded first, class by class; what their rounding adds or
#: lacks is made up by the documents of the classes below.
TIERS = (1 / 8, 1 / 64, 1 / 512)
_UNIT = "struct<doc_id:bigint,size:bigint,m:bigint,e0:bigint,p:double>"
_NEAR = 1e-9


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, units, target) from (source, size, m): one row a source."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
    # in rising order of cap over weight the first level that fits is the common one; sources before it stand at their cap
    per = per.withColumn("common", F.first("fits", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("most"), F.col("common") * F.col("weight"))
    return per.select("source", "source_size", "units", F.coalesce(target, F.col("most")).cast("double").alias("target"))


def _fold(seed: int) -> str:
    """SQL that turns ``units``, an ordered array of undecided documents, into struct(done, cur)."""
    empty = f"named_struct('done', cast(array() as array<{_UNIT}>), 'cur', cast(null as {_UNIT}))"

    def unit(of: str, p: str) -> str:
        return f"named_struct('doc_id', {of}.doc_id, 'size', {of}.size, 'm', {of}.m, 'e0', {of}.e0, 'p', {p})"

    # words that cur can gain while x loses them, and the other way round
    up = "least((1 - s.cur.p) * s.cur.size * s.cur.m, x.p * x.size * x.m)"
    down = "least(s.cur.p * s.cur.size * s.cur.m, (1 - x.p) * x.size * x.m)"
    chance = f"pmod(xxhash64({seed}, s.cur.doc_id, x.doc_id, s.cur.size, x.size), 1000000007L) / 1000000007D"
    moved = f"transform(array(named_struct('up', {up}, 'down', {down}, 'u', {chance})), m -> if(m.u * (m.up + m.down) < m.down, m.up, -m.down))[0]"
    cur_p, x_p = "s.cur.p + d / (s.cur.size * s.cur.m)", "x.p - d / (x.size * x.m)"
    whole = lambda p: f"({p} < {_NEAR} or {p} > 1 - {_NEAR})"
    after = (
        f"transform(array({moved}), d -> transform(array(named_struct('a', {unit('s.cur', cur_p)}, 'b', {unit('x', x_p)})), t -> "
        f"case when {whole('t.a.p')} and {whole('t.b.p')} then named_struct('done', concat(s.done, array({unit('t.a', 'round(t.a.p)')}, {unit('t.b', 'round(t.b.p)')})), 'cur', cast(null as {_UNIT})) "
        f"when {whole('t.a.p')} then named_struct('done', concat(s.done, array({unit('t.a', 'round(t.a.p)')})), 'cur', t.b) "
        f"else named_struct('done', concat(s.done, array({unit('t.b', 'round(t.b.p)')})), 'cur', t.a) end)[0])[0]"
    )
    return f"aggregate(units, {empty}, (s, x) -> if(s.cur is null, named_struct('done', s.done, 'cur', x), {after}))"


def _level(units: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: (key, leaf, doc_id, size, m, e0, p) -> the same, with at most one fractional p a leaf."""
    item = F.struct("doc_id", "size", "m", "e0", "p")
    grouped = units.groupBy("key", "leaf").agg(F.collect_list(F.struct((-F.col("size")).alias("k"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), item.alias("u"))).alias("us"))
    ordered = grouped.select("key", "leaf", F.expr("transform(array_sort(us), v -> v.u)").alias("units"))
    folded = ordered.select("key", "leaf", F.expr(_fold(seed)).alias("f"))
    rows = folded.select("key", "leaf", F.explode(F.expr("if(f.cur is null, f.done, concat(f.done, array(f.cur)))")).alias("u"))
    return rows.select("key", "leaf", "u.*")


def _key(column: str = "source"):
    """A join key that tells a null source from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def _split(units: DataFrame, state: DataFrame) -> DataFrame:
    """Each unit with its certain copies e0 and its fractional rest p, from what its source still has to take."""
    e = F.when(F.col("left_size") > 0, F.col("left_target") / F.col("left_size")).otherwise(F.lit(0.0))
    units = units.join(state.select("key", "cap", e.alias("e")), "key")
    units = units.withColumn("e", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("e"))))
    units = units.withColumn("e0", F.floor(F.col("e") + _NEAR).cast("long"))
    rest = F.when(F.col("size") > 0, F.greatest(F.col("e") - F.col("e0"), F.lit(0.0))).otherwise(F.lit(0.0))
    return units.withColumn("p", F.when(rest < _NEAR, 0.0).when(rest > 1 - _NEAR, 1.0).otherwise(rest))


def _by_lot(seed: int):
    """1 with the chance p, else 0."""
    return (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1000000007)) / 1000000007.0 < F.col("p")).cast("double")


_SETTLED = ["key", "doc_id", "size", "m", "e0", "p"]


def mix(docs: DataFrame, seed: int = 17, cap: float = 3.0) -> DataFrame:
    """One row a unit (rows equal in doc_id, source and size): doc_id, source, size, m, source_size, target, copies."""
    return _mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), seed, cap)


def _mix(sizes: DataFrame, seed: int, cap: float) -> DataFrame:
    """``mix`` from (doc_id, source, size)."""
    sizes = staged(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    targets = staged(source_targets(sizes, cap).withColumn("key", _key()), "targets")
    share = F.col("size") * F.col("m") / F.col("source_size")
    tier = F.lit(len(TIERS))
    for k, least in reversed(list(enumerate(TIERS))):
        tier = F.when(share > least, F.lit(k)).otherwise(tier)
    units = sizes.withColumn("key", _key()).join(targets.select("key", "source_size", "units"), "key")
    units = units.withColumn("tier", F.coalesce(tier, F.lit(len(TIERS))))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    state = targets.select("key", F.lit(float(cap)).alias("cap"), F.col("target").alias("left_target"), F.col("source_size").alias("left_size"))
    done = []
    for k in range(len(TIERS)):
        large = _split(units.where(F.col("tier") == k), state)
        rounded = _level(large.where(open_).withColumn("leaf", F.lit(0).cast("long")), seed + k)
        rounded = rounded.withColumn("p", F.when(open_, _by_lot(seed + k)).otherwise(F.col("p")))
        tier_rows = staged(large.where(~open_).select(*_SETTLED).unionByName(rounded.select(*_SETTLED)), f"tier-{k}")
        done.append(tier_rows)
        words = F.col("size") * F.col("m")
        took = tier_rows.groupBy("key").agg(F.sum(words * (F.col("e0") + F.col("p"))).alias("took"), F.sum(words).alias("of"))
        state = staged(
            state.join(took, "key", "left").select(
                "key", "cap", (F.col("left_target") - F.coalesce("took", F.lit(0.0))).alias("left_target"), (F.col("left_size") - F.coalesce("of", F.lit(0))).alias("left_size")
            ),
            f"left-{k}",
        )
    small = _split(units.where(F.col("tier") == len(TIERS)), state)
    done.append(small.where(~open_).select(*_SETTLED))
    leaf = F.pmod(F.xxhash64(F.lit(seed + 100), "doc_id", "size"), F.ceil(F.col("units") / LEAF))
    rest = small.where(open_).withColumn("leaf", leaf)
    largest = targets.agg(F.max("units")).first()[0] or 0
    depth = 1 + max(0, math.ceil(math.log(max(1, math.ceil(largest / LEAF)), LEAF) - 1e-9))
    for k in range(depth):
        level = staged(_level(rest, seed + 101 + k), f"pivotal-{k}")
        done.append(level.where(~open_).select(*_SETTLED))
        rest = level.where(open_).withColumn("leaf", F.floor(F.col("leaf") / LEAF))
    done.append(rest.withColumn("p", _by_lot(seed + 100)).select(*_SETTLED))
    settled = done[0]
    for rows in done[1:]:
        settled = settled.unionByName(rows)
    copies = F.when(F.col("size") > 0, F.col("e0") + F.col("p")).otherwise(F.lit(0)).cast("long")
    return settled.join(targets.select("key", "source", "source_size", "target"), "key").select("doc_id", "source", "size", "m", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 17, cap: float = 3.0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    placed = Places(docs)
    sizes = placed.bare(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sizes = staged(sizes, "placed-sizes")
    taken = _mix(sizes.select("doc_id", "source", "size"), seed, cap).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words"), "copies")
    on = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words"))
    return placed.repeated(staged(sizes.join(staged(taken, "taken"), on).select("file", "at", "copies"), "copies"))
