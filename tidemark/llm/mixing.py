"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source, in seeded order of its documents, form a line that is
cut into shards of bounded length and into blocks of equal size. Highest
quotients (target / 1, 3, 5, ...) give every source, then every shard of a
source, an integer number of blocks; in a shard a seeded permutation picks that
many blocks, whole passes over all blocks first. A document takes the words
that it has in the blocks picked.

Only totals go to the driver: a row a source, and at most MAX_SHARDS plus one a
source for shards. Above MAX_SOURCES sources these stay where they are too: targets come
of a water level that is raised by sums until it holds, blocks of a threshold on the
quotients that is closed in on by counts, and what is left goes to the first by order;
only shards of sources that have several (MAX_SHARDS at most) reach the driver. Both ways
give the same mix, save that the second divides in floating point. For a mix, texts are read once; what is shuffled is a row of about
40 bytes a document, dealt by (source, shard), so a hot source is spread. ``copies``,
which returns the documents themselves, reads texts a second time and moves them
once, to where their takes are.

Cases: null and empty texts have size 0 and take 0; a null source counts as a
source of its own, last in order; ties and repeated rows are interchangeable;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship

from ._common import documents, stage

WEIGHTS = (5, 2, 1)  #: by rank of the source, repeating
MAX_REPEATS = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
MAX_SHARDS = 100_000
MAX_SOURCES = 100_000  #: planned on the driver; more are planned where they are
SEED = 42


def water_fill(sizes: list[int], weights: list[int], cap: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of all sizes by weight, none above ``cap`` times its size; what
    is above goes to the others by weight until none is above. Exact."""
    total = sum(sizes)
    out = [Fraction(0)] * len(sizes)
    # the first to reach its cap is the one with the least cap for its weight
    order = sorted(range(len(sizes)), key=lambda i: Fraction(cap * sizes[i], weights[i]))
    left, weight = Fraction(total), sum(weights)
    for k, i in enumerate(order):
        if Fraction(cap * sizes[i]) * weight < left * weights[i]:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
            weight -= weights[i]
        else:
            for j in order[k:]:
                out[j] = left * weights[j] / weight
            break
    return out


def sainte_lague(votes: list[Fraction | int], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), none above ``most``; ties
    go to the earlier entry. A divisor gives nearly all seats at once, then a
    heap gives the rest one by one, so any number of seats is quick."""
    seats = min(seats, sum(most))
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)

    def above(t: float) -> list[int]:  # of each entry's quotients, how many are greater than t
        t = Fraction(t)
        return [min(m, max(0, -((t - v) // (2 * t)))) for v, m in zip(votes, most, strict=True)]

    low, high = 0.0, 2.0 * float(max(votes))
    for _ in range(200):  # at most ``seats`` quotients are greater than ``high``
        if seats - sum(above(high)) <= 2 * len(votes) + 16:
            break
        mid = (low + high) / 2
        low, high = (low, mid) if sum(above(mid)) <= seats else (mid, high)
    out = above(high)
    heap = [(-Fraction(v) / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if s < most[i] and v]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(block: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of each block in a seeded permutation of ``range(n)``: a Feistel
    network over the next even power of two, walked until inside."""
    out = block.astype(np.uint64)
    n, seed = n.astype(np.uint64), seed.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, s = half[todo], mask[todo], seed[todo]
            left, right = out[todo] >> h, out[todo] & m
            for turn in range(4):
                left, right = right, left ^ (_mix64(right + s * np.uint64(2 * turn + 3) + np.uint64(turn)) & m)
            out[todo] = left << h | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _taken(start, size, words, quota, seed) -> np.ndarray:
    """Words that each document takes: it lies at ``start`` on its shard's line."""
    n = -(-words // BLOCK_WORDS)
    first, last = start // BLOCK_WORDS, np.where(size > 0, (start + size - 1) // BLOCK_WORDS, start // BLOCK_WORDS - 1)
    count = last - first + 1
    row = np.repeat(np.arange(len(size)), count)
    if not len(row):
        return np.zeros(len(size), np.int64)
    block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    covered = np.minimum((block + 1) * BLOCK_WORDS, (start + size)[row]) - np.maximum(block * BLOCK_WORDS, start[row])
    times = (quota // np.maximum(n, 1))[row] + (permuted(block, n[row], seed[row]) < (quota % np.maximum(n, 1))[row])
    return np.bincount(row, weights=covered * times, minlength=len(size)).astype(np.int64)


def _step(total: int) -> int:
    """Words of a shard."""
    return max(SHARD_WORDS, -(-total // MAX_SHARDS))


def _shard_rows(lengths: dict, quotas: dict) -> list[tuple]:
    """(source, shard, words, quota) of every shard: a source's blocks go to its shards by highest quotients."""
    rows = []
    for s, quota in quotas.items():
        own = sorted(lengths[s])
        have = [-(-n // BLOCK_WORDS) for _, n in own]
        for (shard, n), q in zip(own, sainte_lague(have, quota, [MAX_REPEATS * h for h in have]), strict=True):
            rows.append((s, shard, n, q))
    return rows


_SHARDS = "source string, shard long, words long, quota long"


def _plan(spark: SparkSession, totals: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """On the driver: source, source_size, target and shards of every source, and a
    function from the lengths of the shards (source, shard, n) to their quotas."""
    sources = totals.collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    total = sum(r["n"] for r in sources)
    targets = water_fill([r["n"] for r in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    plan = [(r["source"], r["n"], float(t), max(1, -(-r["n"] // _step(total)))) for r, t in zip(sources, targets, strict=True)]

    def quotas_of(shards: DataFrame) -> DataFrame:
        lengths: dict = {}
        for r in shards.collect():  # MAX_SHARDS + sources rows at most
            lengths.setdefault(r["source"], []).append((r["shard"], r["n"]))
        blocks = {s: sum(-(-n // BLOCK_WORDS) for _, n in x) for s, x in lengths.items()}
        order = [r["source"] for r in sources if r["source"] in blocks]
        goal = dict(zip((r["source"] for r in sources), targets, strict=True))
        quotas = sainte_lague([goal[s] for s in order], round(Fraction(total, BLOCK_WORDS)), [MAX_REPEATS * blocks[s] for s in order])
        return spark.createDataFrame(_shard_rows(lengths, dict(zip(order, quotas, strict=True))), _SHARDS)

    return spark.createDataFrame(plan, "source string, source_size long, target double, shards long"), quotas_of


def _ranked(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """source, n and rank (from 0, by code point, null last), by the counts of range partitions."""
    dealt = totals.withColumn("last", F.col("source").isNull()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "last", "source")
    dealt = dealt.sortWithinPartitions("last", "source").withColumn("place", F.monotonically_increasing_id())
    dealt = stage(dealt.withColumn("part", F.shiftright("place", 33)), "sources")
    before, at = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row a partition
        before.append((r["part"], at))
        at += r["count"]
    starts = spark.createDataFrame(before, "part long, before long")
    return dealt.join(F.broadcast(starts), "part").select("source", "n", (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def _spread_plan(spark: SparkSession, totals: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The same where sources do not fit the driver: nothing but sums and counts reaches it."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = _ranked(spark, totals).withColumn("weight", weight)
    whole = lambda c: c.cast("decimal(19,0)")
    total = int(sources.agg(F.sum(whole(F.col("n")))).first()[0])
    cap = F.col("n") * MAX_REPEATS
    left, weights = total, None
    while True:  # sources whose cap is below the level are full; the level rises for the others
        full = F.lit(False) if weights is None else whole(cap) * whole(F.lit(weights)) < whole(F.lit(left)) * whole(F.col("weight"))
        got = sources.agg(F.sum(whole(F.when(full, cap).otherwise(0))).alias("caps"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")).first()
        now = (total - int(got["caps"]), int(got["w"]))
        if now == (left, weights):
            break
        left, weights = now
        if not weights:
            break
    target = F.when(full, cap.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(weights or 1)))
    plan = sources.select("source", "rank", F.col("n").alias("source_size"), target.alias("target"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(_step(total)))).cast("long").alias("shards"))
    plan = stage(plan, "targets")

    def quotas_of(shards: DataFrame) -> DataFrame:
        shards = stage(shards.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_WORDS)).cast("long")), "shards")
        blocks = shards.groupBy(F.col("source").alias("s")).agg((F.sum("blocks") * MAX_REPEATS).alias("most"))
        votes = stage(plan.join(blocks, F.col("source").eqNullSafe(F.col("s"))).select("source", "rank", "target", "most", "shards"), "votes")
        quotas = _spread_quotas(votes, round(Fraction(total, BLOCK_WORDS)))
        own = shards.join(quotas.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        lengths: dict = {}
        wanted: dict = {}
        for r in own.where("shards > 1").collect():  # of sources above a shard's words: MAX_SHARDS + their number at most
            lengths.setdefault(r["source"], []).append((r["shard"], r["n"]))
            wanted[r["source"]] = r["quota"]
        several = spark.createDataFrame(_shard_rows(lengths, wanted), _SHARDS)
        return own.where("shards = 1").select("source", "shard", F.col("n").alias("words"), F.least("quota", F.col("blocks") * MAX_REPEATS).alias("quota")).unionByName(several)

    return plan.drop("rank"), quotas_of


PROBES = 32  #: thresholds that one pass counts
EQUAL = 1e-12  #: quotients that differ by less, in parts of them, are equal but for rounding


def _spread_quotas(votes: DataFrame, seats: int) -> DataFrame:
    """source, shards and quota by highest quotients target / (2 s + 1), none above ``most``; ties go to the lower rank."""
    bounds = votes.agg(F.max("target").alias("t"), F.sum("most").alias("m")).first()
    seats = min(seats, int(bounds["m"] or 0))
    low, high = 0.0, 2.0 * float(bounds["t"] or 0.0)

    def above(t) -> Column:  # of a source's quotients, how many are greater than t
        return F.least("most", F.greatest(F.lit(0), F.ceil((F.col("target") - t) / (2 * t)))).cast("long")

    def counted(conditions: list[Column]) -> list[int]:
        return [int(x or 0) for x in votes.agg(*(F.sum(c).alias(f"c{i}") for i, c in enumerate(conditions))).first()]

    if not seats or not high:
        return votes.select("source", "shards", F.lit(0).cast("long").alias("quota"))
    # at most ``seats`` quotients are greater than ``high``, more than that greater than ``low``
    while high - low > high * EQUAL:
        probes = sorted({low + (high - low) * (i + 1) / (PROBES + 1) for i in range(PROBES)} - {low, high})
        sums = counted([above(F.lit(t)) for t in probes])
        fits = [t for t, n in zip(probes, sums, strict=True) if n <= seats]
        low, high = max((t for t, n in zip(probes, sums, strict=True) if n > seats), default=low), min(fits, default=high)
        if fits and seats in sums:
            break
    # the quotients between are equal: those of the lowest ranks have a seat more
    given = above(F.lit(high))
    may = (F.col("target") > 0) & (given < F.col("most")) & (above(F.lit(low)) > given if low else F.col("target") / (2 * given + 1) > 0)
    rest = seats - counted([given])[0]
    first, last = -1, int(votes.agg(F.max("rank")).first()[0])  # ranks up to ``first`` are too few, up to ``last`` enough
    while rest and last - first > 1:
        probes = sorted({first + (last - first) * (i + 1) // (PROBES + 1) for i in range(PROBES)} - {first, last}) or [(first + last) // 2]
        sums = counted([(may & (F.col("rank") <= t)).cast("long") for t in probes])
        last = min((t for t, n in zip(probes, sums, strict=True) if n >= rest), default=last)
        first = max((t for t, n in zip(probes, sums, strict=True) if n < rest), default=first)
    more = (may & (F.col("rank") <= last)).cast("long") if rest else F.lit(0)
    return votes.select("source", "shards", (given + more).cast("long").alias("quota"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: tuple = ()
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    spark = df.sparkSession
    sizes = stage(
        df.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ),
        "words",
    )
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n"))
    plan = _plan if totals.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else _spread_plan
    by_source, quotas_of = plan(spark, totals)
    dealt = sizes.join(by_source, sizes["source"].eqNullSafe(by_source["source"])).select(
        "doc_id", sizes["source"], "size", "source_size", "target",
        F.xxhash64(F.lit(seed), "doc_id").alias("turn"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "shards").alias("shard"),
    )
    by_shard = quotas_of(dealt.groupBy("source", "shard").agg(F.sum("size").alias("n")))
    line = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size")
    laid = (
        dealt.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(by_shard.withColumnRenamed("source", "s").withColumnRenamed("shard", "h"), F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
        .withColumn("key", F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0")), "shard"))
    )
    out = ["doc_id", "source", "size", "source_size", "target"]
    ship(spark)

    @F.pandas_udf("long")
    def taken(start, size, words, quota, key):
        import pandas as pd

        return pd.Series(_taken(*(c.to_numpy() for c in (start, size, words, quota, key))))

    return laid.select(*out, taken("start", "size", "words", "quota", "key").alias("taken"))


def copies(df: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: each row of ``df`` as often as the words it takes
    make whole documents, a rest by a seeded draw. Documents without words stay
    once. Rows keep the columns of ``df``; needs doc_id, text and source."""
    got = mix(df, seed=seed).groupBy("doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"))
    rate = F.when(F.col("size") > 0, F.col("taken") / (F.greatest("size", F.lit(1)) * F.col("n"))).otherwise(F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("k_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = got.select(F.col("doc_id").alias("k_id"), F.col("size").alias("k_size"), rate.alias("rate"))
    times = F.when(F.col("k_size") == 0, 1).otherwise(F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    kept = got.select("k_id", "k_size", times.alias("times")).where("times > 0")
    joined = df.withColumn("k_words", size).join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_words") == F.col("k_size")))
    return joined.withColumn("k_copy", F.explode(F.expr("sequence(1, times)"))).select(*(df[c] for c in df.columns))


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
