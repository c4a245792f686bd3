"""An exact index over the stored vectors: cells of near ones, left out of a search where the triangle inequality says that they hold nothing better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.vectors import dot, unit
from engram.operators import vectors as K
from engram.sources.scratch import scratch
from engram.sources.store import Refused, Snapshot, Transaction

#: The rule that says the dimension of all stored vectors.
DIMENSION = "vectors.dimension"
#: Vectors in cells from which on a search looks at the cells first; below, it reads them all. The result is the same.
LEAST = 50_000
#: Slack of bounds, in radians, for rounding.
SLACK = 1e-7


def probe(at: Snapshot) -> int:
    """The dimension of the stored vectors; 0 if there are none."""
    if DIMENSION not in at.rules and at.manifest.get("vectors"):
        row = Snapshot.read(at, "vectors").select(F.size("embedding").alias("n")).first()
        return row["n"] if row else 0
    return at.rules.get(DIMENSION, 0)


def _angle(a: Column, b: Column) -> Column:
    """Between unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def _assign(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (agent_id, kind, id, embedding) with the nearest cell of their agent and the angle to its centre; both null for agents without cells."""
    write = scratch(rows.sparkSession)
    name = F.concat_ws("\0", "kind", "id")
    rows = write(rows.select("agent_id", "kind", "id", "embedding"), "to_assign")
    asked = rows.select("agent_id", name.alias("id"), F.lit(0).cast("long").alias("ord"), F.col("embedding").alias("v"))
    centres = cells.select("agent_id", F.col("cell").alias("id"), F.xxhash64("cell").alias("ord"), F.lit("").alias("kind"), F.col("centre").alias("v"))
    # The centres are the few: they are asked for by being near, so the rows are what is scanned.
    near = K.top_k(asked, centres, 1, scope=["agent_id"]).select("agent_id", F.col("q").alias("_name"), F.col("id").alias("cell"))
    out = rows.withColumn("_name", name).join(near, ["agent_id", "_name"], "left").join(cells.select("agent_id", "cell", "centre"), ["agent_id", "cell"], "left")
    return out.select("agent_id", "kind", "id", "embedding", "cell", _angle(unit(F.col("embedding")), F.col("centre")).alias("angle"))


def _grown(cells: DataFrame, assigned: DataFrame) -> DataFrame:
    """cells that reach to all the vectors assigned to them. What was deleted leaves a cell as wide as it was, which costs time, never results."""
    reach = assigned.filter("cell is not null").groupBy("agent_id", "cell").agg(F.max("angle").alias("_reach"), F.count("*").alias("_more"))
    out = cells.join(reach, ["agent_id", "cell"], "left")
    return out.select("agent_id", "cell", "centre", F.greatest("radius", F.coalesce("_reach", F.lit(0.0))).alias("radius"), (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"))


def save_vectors(tx: Transaction, vectors: DataFrame) -> None:
    """vectors: id, agent_id, kind ('': wiki_page), v. Stored with length one, in the nearest cell of their agent. Null and zero vectors aren't stored. The first vectors lay down the dimension of the
    store, as a rule of its versions; others are refused, whichever writer they come from."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("wiki_page"))
    some = vectors.filter("v is not null and exists(v, x -> x != 0)")
    write = scratch(vectors.sparkSession)
    rows = write(some.select("id", "agent_id", kind.alias("kind"), unit(F.col("v")).cast("array<float>").alias("embedding")), "vectors")
    sizes = {r[0] for r in rows.select(F.size("embedding")).distinct().limit(2).collect()}
    if not sizes:
        return
    known = {probe(tx)} - {0}
    if len(sizes | known) > 1:
        raise Refused(f"vectors of different dimensions: {sorted(sizes | known)}")
    tx.demand(DIMENSION, sizes.pop())
    cells = write(tx.read_for("vector_cells", rows), "cells")
    if not cells.limit(1).count():
        return tx.upsert("vectors", rows)
    assigned = write(_assign(rows, cells), "assigned")
    tx.upsert("vectors", assigned.drop("angle"))
    tx.upsert("vector_cells", _grown(cells, assigned))


def rebuild_cells(tx: Transaction, agents: DataFrame) -> None:
    """New cells for the vectors of agents (agent_id): about the square root of their number, whose centres are vectors drawn by a hash."""
    write = scratch(agents.sparkSession)
    parts = tx.store.parts_of(agents)
    if not parts:
        return
    mine = agents.select("agent_id").distinct()
    stored = tx.read("vectors", parts)
    rows = write(stored.join(mine, "agent_id", "left_semi"), "vectors")
    counts = rows.groupBy("agent_id").agg(F.count("*").alias("_n"))
    drawn = F.pmod(F.xxhash64("kind", "id"), F.col("_n")) < F.ceil(F.sqrt("_n"))
    centres = rows.join(counts, "agent_id").filter(drawn).select(
        "agent_id", F.hex(F.xxhash64("kind", "id")).alias("cell"), unit(F.col("embedding")).alias("centre"), F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n"),
    ).dropDuplicates(["agent_id", "cell"])
    centres = write(centres, "centres")
    assigned = write(_assign(rows, centres), "assigned")
    others = stored.join(mine, "agent_id", "left_anti")
    tx.write("vectors", others.unionByName(assigned.drop("angle"), allowMissingColumns=True), parts)
    old = tx.read("vector_cells", parts).join(mine, "agent_id", "left_anti")
    tx.write("vector_cells", old.unionByName(_grown(centres, assigned)), parts)


def nearest(at: Snapshot, queries: DataFrame, k: int, kind: str = "", least: int | None = None, told: dict | None = None) -> DataFrame:
    """The k stored vectors nearest to each query (id, agent_id, ord, v) among those of its agent: agent_id, q, id, kind, score, rank, as K.top_k gives them. kind: only of one kind.

    Where an agent's vectors lie in cells, a query first reads the nearest cells that hold k vectors. Its k-th best score then leaves out every cell whose centre is so far that even its nearest
    point would score less, and only the others are read. Vectors outside of cells are always read. Only the parts of the store that the queries' agents lie in are read at all.
    told: gets how many pairs of a query and a vector there are, and how many were scored.
    """
    write = scratch(queries.sparkSession)
    q = write(queries.select("id", "agent_id", "ord", "v"), "queries")
    parts = at.store.parts_of(q)
    shape = lambda df: df.select("agent_id", "cell", "id", F.xxhash64("id").alias("ord"), "kind", F.col("embedding").alias("v"))
    v = shape(at.read("vectors", parts))
    v = v.filter(F.col("kind") == kind) if kind else v
    cells = at.read("vector_cells", parts).join(q.select("agent_id").distinct(), "agent_id", "left_semi")
    held = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if at.manifest.get("vector_cells") else 0
    if held < (LEAST if least is None else least) or not held:
        return K.top_k(q, v, k, scope=["agent_id"])

    centres = cells.select("agent_id", F.col("cell").alias("id"), F.col("centre").alias("v"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))
    pairs = K.cosines(q, centres, ["agent_id"]).select("agent_id", "q", F.col("id").alias("cell"), angle.alias("angle"))
    pairs = pairs.join(cells.select("agent_id", "cell", "radius", "n"), ["agent_id", "cell"])
    best = F.greatest(F.lit(0.0), F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius") - SLACK)))
    before = F.sum("n").over(Window.partitionBy("agent_id", "q").orderBy("angle", "cell").rowsBetween(Window.unboundedPreceding, -1))
    pairs = write(pairs.withColumn("best", best).withColumn("first", F.coalesce(before, F.lit(0)) < k), "pairs")

    def read(which: DataFrame) -> DataFrame:
        asked = q.withColumnRenamed("id", "q").join(which.select("agent_id", "q", "cell"), ["agent_id", "q"])
        asked = asked.select("agent_id", "cell", F.col("q").alias("id"), "ord", "v")
        wanted = which.select("agent_id", "cell").distinct()
        return K.top_k(asked, v.join(wanted, ["agent_id", "cell"], "left_semi"), k, scope=["agent_id", "cell"]).drop("cell", "rank")

    first = write(read(pairs.filter("first")), "first")
    kth = F.row_number().over(Window.partitionBy("agent_id", "q").orderBy(F.col("score").desc()))
    bar = first.withColumn("_n", kth).filter(F.col("_n") == k).select("agent_id", "q", F.col("score").alias("bar"))
    rest = pairs.filter("not first").join(bar, ["agent_id", "q"], "left").filter("bar is null or best >= bar")
    rest = write(rest, "rest")
    loose = K.top_k(q, v.filter("cell is null").drop("cell"), k, scope=["agent_id"]).drop("rank")
    found = first.unionByName(read(rest)).unionByName(loose).withColumn("ord", F.xxhash64("id"))
    if told is not None:
        count = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        told |= {"pairs": count(pairs), "scored": count(pairs.filter("first")) + count(rest)}
    rank = F.row_number().over(Window.partitionBy("agent_id", "q").orderBy(F.col("score").desc(), "kind", "ord"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("agent_id", "q", "id", "kind", "score", "rank")
