"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm._spark import BROADCAST_BYTES, Workspace, rank_in_groups, ranges_for

#: Standard deviations around the mode beyond which a hypergeometric count has a probability under 10**-30.
REACH = 12
#: Rows below which NumPy draws hypergeometric counts itself.
SMALL = 10**9
#: Partitions whose counts go into one literal table.
LITERAL_ROWS = 20_000
#: Bits of a row's place in its partition, in the ids that Spark counts up.
PLACE_BITS = 33


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard, drawn as a uniform shuffle would: row sums are `sizes`,
    column sums differ by at most one. Multivariate hypergeometric draws from the free places: first for one half of the partitions together, then inside each half,
    until a group's rows are few enough for NumPy's own draws, partition by partition (some microseconds each)."""
    total = sum(sizes)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    return _split(np.random.default_rng(seed), sizes, free)


def _split(rng: np.random.Generator, sizes: list[int], free: list[int]) -> list[list[int]]:
    if len(sizes) == 1:
        return [free]
    out: list[list[int]] = []
    if sum(sizes) < SMALL:
        places = np.array(free, dtype=np.int64)
        for size in sizes:
            row = rng.multivariate_hypergeometric(places, size, method="marginals")
            places -= row
            out.append(row.tolist())
        return out
    half = len(sizes) // 2
    # The marginal method draws one (univariate) hypergeometric count after another.
    left, places, row = sum(sizes[:half]), sum(free), []
    for f in free:
        places -= f
        row.append(hypergeometric(rng, f, places, left))
        left -= row[-1]
    return _split(rng, sizes[:half], row) + _split(rng, sizes[half:], [f - r for f, r in zip(free, row, strict=True)])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows out of good + bad are good, for numbers of any size: the law's weights are made from the mode outwards by the ratio
    of neighbouring ones, and inverted; what lies REACH deviations away is under a double's precision."""
    low, high, n = max(0, draws - bad), min(good, draws), good + bad
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    spread = (draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5
    reach = int(REACH * spread) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    log_ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate(([0.0], np.cumsum(log_ratio)))
    below = np.cumsum(np.exp(weights - weights.max()))
    return first + min(int(np.searchsorted(below, rng.random() * below[-1], side="right")), last - first)


def _cuts(work: Workspace, order: list[int], matrix: list[list[int]]) -> DataFrame:
    """p, cuts (running sums of a partition's counts): a literal table, or, for very many partitions, one that is written LITERAL_ROWS at a time."""

    def literal(first: int) -> DataFrame:
        rows = zip(order[first : first + LITERAL_ROWS], matrix[first : first + LITERAL_ROWS], strict=True)
        counts = json.dumps([{"p": p, "cuts": np.cumsum(row).tolist()} for p, row in rows])
        return work.spark.range(1).select(F.explode(F.from_json(F.lit(counts), "array<struct<p:int,cuts:array<bigint>>>")).alias("c")).select("c.p", "c.cuts")

    tables = [literal(0)] if len(order) <= LITERAL_ROWS else [work.write(literal(i), f"cuts{i}") for i in range(0, len(order), LITERAL_ROWS)]
    return reduce(DataFrame.unionAll, tables)


def shuffle_into_shards(df: DataFrame, key: list[Column], shards: int = 8, seed: int = 20) -> DataFrame:
    """df with shard (0..shards-1, sizes at most one apart) and slot (0.. without gaps inside each shard).

    The rows are written once, so that all passes see the same partitions. The matrix says how many rows each partition
    sends to each shard. A partition is permuted inside its task (sorted by a seeded hash of `key`) and cut by its counts; the rows are
    exchanged once, by shard and range of a second hash, which permutes each shard. Only the partitions' sizes
    reach the driver, and their counts come back as one row per partition, which is broadcast while that is small. Rows equal in `key` may go anywhere; which of
    them goes where is arbitrary. The same files, split alike, give the same result.
    Nulls hash like values; empty and long texts are rows like others; an empty table gives no rows. Columns named shard or slot are replaced; other
    names never clash.
    """
    spark = df.sparkSession
    work = Workspace(spark, "sharding")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct(*[df[c] for c in kept]).alias("row"), F.xxhash64(F.lit(seed), *key).alias("h"), F.xxhash64(*key, F.lit(seed)).alias("tie"))
    rows = work.write(rows, "rows")
    sizes = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], shards, seed)
    cuts = _cuts(work, order, matrix)
    small = len(order) * 8 * (shards + 4) <= BROADCAST_BYTES  # one row of `shards` numbers per partition
    local = rows.sortWithinPartitions("h", "tie").withColumn("at", F.monotonically_increasing_id())
    local = local.select("row", F.shiftright("at", PLACE_BITS).cast("int").alias("p"), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"))
    sent = local.join(F.broadcast(cuts) if small else cuts, "p").withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("place"))).cast("int")).drop("cuts")
    again = rank_in_groups(
        sent,
        ["shard"],
        F.xxhash64(F.lit(seed + 2), "p", "place"),
        [F.col("p"), F.col("place")],
        "slot",
        buckets=ranges_for(-(-sum(sizes.values()) // shards)),
        groups=shards,
    )
    return again.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", "slot")
