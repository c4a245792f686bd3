"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Star rewritings after which a graph that still changes is taken as a fault: enough for a path of 2**100 nodes.
ROUNDS = 200
#: Links that go into a file.
FILE_ROWS = 50_000
#: Counted links up to which one task finishes what is left.
LOCAL_LINKS = 200_000


def connected_components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame], name: str = "cc") -> DataFrame:
    """Components of undirected links (src, dst), as (node, component = its smallest node).

    Alternates two star rewritings: every node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour, until each component is a star around its smallest node. The number of rounds grows
    with the logarithm of a component's diameter; ROUNDS without an end raise. As soon as at most LOCAL_LINKS links are left, which are counted, one task ends it, with the same result.
    Minima are pre-aggregated before they are
    shuffled, and written before they are joined back, so that Spark can split a node of very many links in that join.
    `write(df, name)` writes a table and reads it again; it cuts the lineage of each round. Self-links and repeated links don't matter; nodes without
    a link to another node are not returned; null ends are ignored.
    """
    def named(links: DataFrame) -> DataFrame:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
            links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(),
        )

    def put(df: DataFrame, part: str) -> DataFrame:
        """A round's tables have no more rows than there are links; few of them go into few files."""
        return write(df.coalesce(max(8, links // FILE_ROWS)), f"{name}_{part}")

    pairs = edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    current = write(pairs, f"{name}_links0")
    before, links = None, current.count()
    if links <= LOCAL_LINKS:
        return named(write(_stars(current), f"{name}_stars"))
    for step in range(1, ROUNDS + 1):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"least{step}")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = put(large.distinct(), f"large{step}")
        least = put(large.groupBy("u").agg(F.min("v").alias("m")), f"kept{step}")
        kept = large.join(least, "u")
        small = kept.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        current = put(small.filter("u != v").distinct(), f"links{step}")
        state = current.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before, links = tuple(state), state[0]
        if links <= LOCAL_LINKS:
            return named(write(_stars(current), f"{name}_stars"))
    else:
        raise RuntimeError(f"connected components: no end after {ROUNDS} rounds")
    return named(current)


def _stars(links: DataFrame) -> DataFrame:
    """links (u, v) of at most LOCAL_LINKS rows as stars (u, v = the smallest node of its component, u != v), by one task that joins trees."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = above[y]
                x = y
            return x

        field = None
        for batch in batches:
            field = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = top(u), top(v)
                above[max(a, b)] = min(a, b)
        found = [(x, top(x)) for x in above]
        found = [(x, y) for x, y in found if x != y]
        for i in range(0, len(found), 10_000):
            u, v = zip(*found[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, field), pa.array(v, field)], ["u", "v"])

    return links.coalesce(1).mapInArrow(run, f"u {kind}, v {kind}")
