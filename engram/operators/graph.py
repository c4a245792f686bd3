"""Graph operators over edge tables (agent_id, source_id, target_id, kind, weight)."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import normalize_id, wikilinks
from engram.operators.components import connected_components
from engram.operators.vectors import similar_around
from engram.sources.scratch import scratch


def first_edge(edges: DataFrame, kind: str) -> DataFrame:
    """The first edge of a kind per source: the heaviest, ties by target."""
    w = Window.partitionBy("agent_id", "source_id").orderBy(F.col("weight").desc(), F.col("target_id"))
    return edges.filter(F.col("kind") == kind).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Steps that walks take one by one; longer ones go on by doubled jumps.
SINGLE_STEPS = 8


def resolve_replacements(starts: DataFrame, edges: DataFrame, points: DataFrame) -> DataFrame:
    """Follows sequel edges from each start (agent_id, id) to the first point that isn't archived: agent_id, id, replacement,
    hops. Starts without one are left out, and so are walks that run in a circle.
    All starts move one step in each round, until none is walking; a round is written, and only carries those still walking. Those that walk after SINGLE_STEPS rounds look their end up
    in a table of jumps, which double in length each round: a chain of n costs log2(n) rounds.
    """
    write = scratch(starts.sparkSession)
    step = write(first_edge(edges, "sequel").select(F.col("agent_id").alias("ea"), F.col("source_id").alias("es"), F.col("target_id").alias("next")), "steps")
    alive = points.select(F.col("agent_id").alias("pa"), F.col("id").alias("pid"), F.col("status").alias("pstatus"))
    walking = starts.select("agent_id", "id", F.col("id").alias("at")).distinct()
    done = None
    for hop in range(1, SINGLE_STEPS + 1):
        moved = walking.join(step, (F.col("agent_id") == F.col("ea")) & (F.col("at") == F.col("es"))).filter("next != id and next != at")
        moved = moved.join(alive, (F.col("agent_id") == F.col("pa")) & (F.col("next") == F.col("pid")))
        moved = write(moved.select("agent_id", "id", "next", "pstatus"), f"hop{hop}")
        found = moved.filter("pstatus != 'archived'").select("agent_id", "id", F.col("next").alias("replacement"), F.lit(hop).alias("hops"))
        done = found if done is None else done.unionByName(found)
        walking = moved.filter("pstatus = 'archived'").select("agent_id", "id", F.col("next").alias("at"))
        if walking.isEmpty():
            return done
    ends = _chain_ends(step.join(alive, (F.col("ea") == F.col("pa")) & (F.col("next") == F.col("pid"))), write)
    far = walking.join(ends, (F.col("agent_id") == F.col("ea")) & (F.col("at") == F.col("es"))).filter("replacement != id")
    return done.unionByName(far.select("agent_id", "id", "replacement", (F.lit(SINGLE_STEPS) + F.col("hops")).cast("int").alias("hops")))


def _chain_ends(steps: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """steps (ea, es, next, pstatus of next): ea, es, replacement (the first one that isn't archived on the way), hops. A jump over jumps doubles their length, and an end stays where it is; what
    has no end after as many rounds as the number of steps has bits is a circle."""
    jumps = write(steps.select("ea", "es", F.col("next").alias("to"), F.lit(1).cast("long").alias("hops"), (F.col("pstatus") != "archived").alias("ended")), "jumps0")
    n = jumps.count()
    for turn in range(1, n.bit_length() + 2):
        open_ = jumps.filter("not ended")
        if open_.isEmpty():
            break
        second = jumps.select(F.col("ea").alias("_a"), F.col("es").alias("_s"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))
        longer = open_.join(second, (F.col("ea") == F.col("_a")) & (F.col("to") == F.col("_s")))
        longer = longer.select("ea", "es", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"))
        jumps = write(jumps.filter("ended").unionByName(longer), f"jumps{turn}")
    return jumps.filter("ended").select("ea", "es", F.col("to").alias("replacement"), "hops")


def bfs_hops(seeds: DataFrame, edges: DataFrame, is_page: DataFrame, max_hops: int) -> DataFrame:
    """Nodes within max_hops of the seeds (agent_id, id), with the fewest hops: agent_id, id, hops. Pages (agent_id, id in is_page) go
    on along all edges both ways; all others along has_page edges only. Each frontier is written, so that a hop doesn't compute the earlier ones again,
    and the walk ends with the first empty one."""
    write = scratch(seeds.sparkSession)
    out = edges.select("agent_id", F.col("source_id").alias("f"), F.col("target_id").alias("t"), F.lit(True).alias("forward"), "kind")
    ways = out.unionByName(edges.select("agent_id", F.col("target_id").alias("f"), F.col("source_id").alias("t"), F.lit(False).alias("forward"), "kind"))
    pages = is_page.select("agent_id", F.col("id").alias("f")).distinct().withColumn("_page", F.lit(True))
    ways = ways.join(pages, ["agent_id", "f"], "left").filter(
        F.col("_page").isNotNull() | (F.col("forward") & (F.col("kind") == "has_page")),
    ).select("agent_id", "f", "t").distinct()
    ways = write(ways, "ways")
    seen = write(seeds.select("agent_id", "id").distinct().withColumn("hops", F.lit(0)), "hop0")
    frontier = seen
    for hop in range(1, max_hops + 1):
        reached = frontier.select("agent_id", F.col("id").alias("f")).join(ways, ["agent_id", "f"]).select("agent_id", F.col("t").alias("id")).distinct()
        frontier = write(reached.join(seen, ["agent_id", "id"], "left_anti").withColumn("hops", F.lit(hop)), f"hop{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def page_links(pages: DataFrame) -> DataFrame:
    """agent_id, source_id, target (normalised id) of the wiki links in body_md; links to itself are dropped."""
    links = pages.select("agent_id", F.col("id").alias("source_id"), F.explode(wikilinks(F.col("body_md"))).alias("t"))
    return links.select("agent_id", "source_id", normalize_id("t").alias("target")).filter("target != source_id").distinct()


def rebuild_links(
    touched: DataFrame,
    pages: DataFrame,
    edges: DataFrame,
    pending: DataFrame,
    now: Column,
    strict_parity: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Edges and pending links after the links of touched pages (agent_id, id) are read anew: their reference edges are replaced
    by links to pages that exist, dead links are recorded. strict_parity: their outgoing edges of all other kinds go, too."""
    keys = touched.select("agent_id", F.col("id").alias("source_id")).distinct()
    links = page_links(pages.join(touched.select("agent_id", "id").distinct(), ["agent_id", "id"], "left_semi"))
    known = pages.select("agent_id", F.col("id").alias("target")).distinct()
    live = links.join(known, ["agent_id", "target"], "left_semi").select(
        "agent_id",
        "source_id",
        F.col("target").alias("target_id"),
        F.lit("references").alias("kind"),
        F.lit(1.0).alias("weight"),
        now.alias("created_at"),
    )
    dead = links.join(known, ["agent_id", "target"], "left_anti").select("agent_id", "source_id", "target", now.alias("created_at"))
    mine = edges if strict_parity else edges.filter("kind = 'references'")
    others = edges.limit(0) if strict_parity else edges.filter("kind != 'references'")
    kept = mine.join(keys, ["agent_id", "source_id"], "left_anti").select(*edges.columns).unionByName(others)
    return kept.unionByName(live.select(*edges.columns)), pending.join(
        keys,
        ["agent_id", "source_id"],
        "left_anti",
    ).select(*pending.columns).unionByName(dead.select(*pending.columns))


def graph_nodes(points: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes of an agent's graph: agent_id, id, node_id, kind, title. An id that is both a point and a page is prefixed with its kind."""
    a = points.select("agent_id", "id", F.lit("interest_point").alias("kind"), F.col("name").alias("title"))
    b = pages.select("agent_id", "id", F.lit("wiki_page").alias("kind"), "title")
    both = a.unionByName(b)
    kinds = F.size(F.collect_set("kind").over(Window.partitionBy("agent_id", "id")))
    return both.withColumn("collides", kinds > 1).withColumn("node_id", F.when(F.col("collides"), F.concat_ws(":", "kind", "id")).otherwise(F.col("id")))


def graph_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes; edges at an id that collides are dropped."""
    plain = nodes.filter(~F.col("collides")).select("agent_id", "id")
    s, t = plain.withColumnRenamed("id", "source_id"), plain.withColumnRenamed("id", "target_id")
    return edges.join(s, ["agent_id", "source_id"], "left_semi").join(t, ["agent_id", "target_id"], "left_semi").select(*edges.columns)


def node_degree(links: DataFrame) -> DataFrame:
    ends = links.select("agent_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("agent_id", "id").agg(F.count("*").alias("degree"))


def parallel_groups(links: DataFrame) -> DataFrame:
    """Edges between the same two nodes, whatever their direction: with place, size, curvature (0 alone, else .25, from three .35) and rotation."""
    pair = [F.col("agent_id"), F.least("source_id", "target_id"), F.greatest("source_id", "target_id")]
    w = Window.partitionBy(*pair)
    size = F.count("*").over(w)
    place = F.row_number().over(w.orderBy("kind", "source_id", "target_id")) - 1
    return _bent(links.withColumn("group_size", size).withColumn("place", place))


def parallel_edges(groups: DataFrame) -> DataFrame:
    """parallel_groups where a row holds all edges between two nodes (agent_id, edges: array of kind, source_id, target_id), so that nothing is exchanged."""
    at = groups.select("agent_id", F.size("edges").cast("long").alias("group_size"), F.posexplode(F.sort_array("edges")).alias("place", "e"))
    return _bent(at.select("agent_id", "e.source_id", "e.target_id", "e.kind", "group_size", "place"))


def _bent(placed: DataFrame) -> DataFrame:
    size = F.col("group_size")
    curve = F.when(size < 2, 0.0).when(size == 2, 0.25).otherwise(0.35)
    return placed.withColumn("curvature", curve).withColumn("rotation", F.when(size < 2, 0.0).otherwise(F.col("place") * F.pi() / size))


#: The golden angle (fixed value).
GOLDEN_ANGLE = 2.399963229728653


def spiral_layout(nodes: DataFrame, group: list[str], order: list[Column], spacing: float) -> DataFrame:
    """x and y on a Fermat spiral by rank in a group."""
    i = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    r, angle = spacing * F.sqrt(F.col("rank") + 1), F.col("rank") * F.lit(GOLDEN_ANGLE)
    return nodes.withColumn("rank", i).withColumn("x", r * F.cos(angle)).withColumn("y", r * F.sin(angle))


#: Nodes whose neighbours lie together, and neighbours in a row, of which a task gets many at once.
BLOCK_NODES, PIECE = 256, 2048


def label_communities(nodes: DataFrame, links: DataFrame, sweeps: int = 10, light: float = 0.3) -> DataFrame:
    """Communities by label propagation, agent by agent: agent_id, id, community. Labels start as the place of a node in order of id; in
    each sweep the nodes take, one after the other, the label with the most weight around them, ties to the smaller one. References weigh `light`,
    other edges 1, parallel ones add up; both kinds are counted, so that the order of the edges doesn't matter.
    """
    places = _places(nodes)
    ends = links.select("agent_id", "source_id", "target_id", F.coalesce(F.col("kind") == "references", F.lit(False)).alias("light"))
    for end, name in (("source_id", "i"), ("target_id", "j")):
        p = places.select(F.col("agent_id").alias("_agent"), F.col("id").alias("_id"), F.col("place").alias(name))
        ends = ends.join(p, F.col("agent_id").eqNullSafe(F.col("_agent")) & (F.col(end) == F.col("_id"))).drop("_agent", "_id")
    way = lambda i, j: F.struct(F.col(i).alias("i"), F.array(F.col(j).cast("int")).alias("near"))
    around = ends.filter("i != j").select("agent_id", "light", F.explode(F.array(way("i", "j"), way("j", "i"))).alias("e")).select("agent_id", "e.i", "e.near", "light")
    return _settled(places, around, sweeps, light)


def similar_communities(vectors: DataFrame, least: float, sweeps: int = 10) -> DataFrame:
    """label_communities of vectors (agent_id, id, v), of which those whose cosine reaches `least` are linked. The links are never rows: a vector's neighbours come as lists."""
    places = _places(vectors)
    placed = vectors.alias("v").join(places.alias("p"), F.col("v.agent_id").eqNullSafe(F.col("p.agent_id")) & (F.col("v.id") == F.col("p.id")))
    around = similar_around(placed.select("v.agent_id", "v.id", F.col("p.place").alias("ord"), "v.v"), least, scope=["agent_id"])
    return _settled(places, around.withColumn("light", F.lit(False)), sweeps, 0.0)


def _places(nodes: DataFrame) -> DataFrame:
    """Nodes (agent_id, id), once each, with their place in order of id; written, as places are joined several times."""
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy("id")) - 1
    return scratch(nodes.sparkSession)(nodes.select("agent_id", "id").filter("id is not null").distinct().withColumn("place", place.cast("long")), "places")


def _settled(places: DataFrame, around: DataFrame, sweeps: int, light: float) -> DataFrame:
    """around (agent_id, i, near, light): lists of neighbours' places. Tasks bring the lists of BLOCK_NODES nodes into order. As each node of a sweep sees the labels of those before it, one task
    an agent makes the sweeps: it keeps one label per node, and reads the neighbours, block after block, from a file of its own."""
    kind = places.schema["agent_id"].dataType.simpleString()
    blocks = around.withColumn("block", F.expr(f"i div {BLOCK_NODES}")).groupBy("agent_id", "block").applyInArrow(_ordered_block, f"agent_id {kind}, block long, piece long, near array<int>")
    labels = blocks.repartition("agent_id").mapInArrow(lambda batches: _sweep(batches, sweeps, light), f"agent_id {kind}, place long, community long")
    labels = labels.select(F.col("agent_id").alias("_agent"), F.col("place").alias("_place"), "community")
    known = places.join(labels, F.col("agent_id").eqNullSafe(F.col("_agent")) & (F.col("place") == F.col("_place")), "left")
    return known.select("agent_id", "id", F.coalesce("community", "place").alias("community"))


def _ordered_block(key: tuple, table: pa.Table) -> pa.Table:
    """The neighbours of a block's nodes by node, those of light edges last, behind how many there are of both: in rows of PIECE numbers."""
    near = table.column("near").combine_chunks()
    near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
    n = pc.list_value_length(near).to_numpy(zero_copy_only=False)
    kinds = 2 * (table.column("i").to_numpy() - key[1].as_py() * BLOCK_NODES) + table.column("light").to_numpy().astype(np.int64)
    keys = np.repeat(kinds, n) << 32 | pc.list_flatten(near).to_numpy().astype(np.int64)
    keys.sort()
    found = np.concatenate([np.bincount(keys >> 32, minlength=2 * BLOCK_NODES).astype(np.int32), keys.astype(np.int32)])
    starts = np.arange(0, len(found), PIECE)
    pieces = pa.ListArray.from_arrays(pa.array(np.append(starts, len(found)), pa.int32()), pa.array(found))
    same = lambda x: pa.array([x.as_py()] * len(starts), x.type)
    return pa.table([same(key[0]), same(key[1]), pa.array(starts // PIECE), pieces], ["agent_id", "block", "piece", "near"])


def _sweep(batches: Iterator[pa.RecordBatch], sweeps: int, light: float) -> Iterator[pa.RecordBatch]:
    """Labels of the nodes that have neighbours, from the pieces of _ordered_block in any order, which are put down in a file."""
    agents: dict = {}
    with tempfile.TemporaryFile() as file:
        end, kinds = 0, None
        for batch in batches:
            kinds = batch.schema
            near = batch.column("near")
            sizes = 4 * pc.list_value_length(near).to_numpy(zero_copy_only=False).astype(np.int64)
            file.write(pc.list_flatten(near).to_numpy().tobytes())
            rows = np.stack([batch.column("block").to_numpy(), batch.column("piece").to_numpy(), end + np.cumsum(sizes) - sizes, sizes])
            end += int(sizes.sum())
            names = np.array(batch.column("agent_id").to_pylist(), dtype=object)
            for agent in set(names):
                agents.setdefault(agent, []).append(rows[:, names == agent])
        file.flush()
        for agent, parts in agents.items():
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            new = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            spans = [(int(rows[0, a]), rows[2:, a:b].T.tolist()) for a, b in zip(new, [*new[1:], rows.shape[1]], strict=True)]
            read = lambda span: np.frombuffer(b"".join(os.pread(file.fileno(), size, at) for at, size in span), np.int32)
            label = np.arange((spans[-1][0] + 1) * BLOCK_NODES, dtype=np.int32)
            for _ in range(sweeps):
                moved = False
                for block, span in spans:
                    moved |= _take_labels(label, block * BLOCK_NODES, read(span), light)
                if not moved:
                    break
            for block, _ in spans:
                at = np.arange(block * BLOCK_NODES, (block + 1) * BLOCK_NODES)
                yield pa.RecordBatch.from_arrays([pa.array([agent] * len(at), kinds.field("agent_id").type), pa.array(at), pa.array(label[at].astype(np.int64))], ["agent_id", "place", "community"])


def _take_labels(label: np.ndarray, first: int, block: np.ndarray, light: float) -> bool:
    """Gives the nodes of a block, in order, the label with the most weight around them; whether one has changed."""
    n, near = block[: 2 * BLOCK_NODES].reshape(-1, 2), block[2 * BLOCK_NODES :]
    ends, moved, start = n.sum(axis=1).cumsum().tolist(), False, 0
    for k, (end, n_light) in enumerate(zip(ends, n[:, 1].tolist(), strict=True)):
        if end > start:
            votes = label[near[start:end]]
            if n_light:
                order = np.argsort(votes, kind="stable")
                votes, is_light = votes[order], order >= end - start - n_light
            else:
                votes.sort()
            best = int(votes[0])
            if best != votes[-1]:
                new = np.flatnonzero(np.append(True, votes[1:] != votes[:-1]))
                weight = np.diff(np.append(new, len(votes)))
                if n_light:
                    lights = np.add.reduceat(is_light.astype(np.int64), new)
                    weight = weight - lights + light * lights
                best = int(votes[new[weight.argmax()]])
            if best != label[first + k]:
                label[first + k], moved = best, True
        start = end
    return moved


def group_points(points: DataFrame, pairs: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Components of points (id) under similar pairs (a, b), singletons with themselves: id, component, size. Sizes are counted and written before they
    are joined, so that a component of very many points isn't brought together."""
    found = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), write)
    every = points.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    every = write(every, "grouped")
    sizes = write(every.groupBy("component").agg(F.count("*").alias("size")), "group_sizes")
    return every.join(sizes, "component").select("id", "component", "size")


def conflict_queues(members: DataFrame, history: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Components that share points of history form a queue: queue (its smallest component), component, affinity, place. members: id, component;
    history: point, hist, sim. Components connected through shared points, directly or not, share a queue; in it, the one with
    the larger similarity to any shared point comes first, ties by component."""
    links = history.join(members, F.col("point") == F.col("id")).groupBy("hist", "component").agg(F.max("sim").alias("sim"))
    links = write(links, "history_of_components")
    several = write(links.groupBy("hist").agg(F.count("*").alias("n")).filter("n > 1").select("hist"), "shared_points")
    shared = write(links.join(several, "hist").select("hist", "component", "sim"), "shared")
    edges = shared.select(F.concat(F.lit("h:"), "hist").alias("src"), F.concat(F.lit("c:"), "component").alias("dst"))
    found = connected_components(edges, write, "queues").filter(F.col("node").startswith("c:"))
    # The smallest node is a component, as "c:" comes before "h:".
    queues = found.select(F.substring("node", 3, 2**31 - 1).alias("comp"), F.substring("component", 3, 2**31 - 1).alias("queue"))
    best = shared.groupBy("component").agg(F.max("sim").alias("affinity"))
    return _queue_places(best.join(queues, F.col("component") == F.col("comp")).select("queue", "component", "affinity"), write)


def _queue_places(rows: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows (queue, component, affinity) with their place in the queue. No task gets all of a queue: rows are dealt by ranges of their order and written, and a row's place is
    the one in its range behind the rows of the ranges before it, which are counted."""
    order = [F.col("affinity").desc(), F.col("component")]
    dealt = write(rows.repartitionByRange("queue", *order).withColumn("_range", F.spark_partition_id()), "queue_ranges")
    before = Window.partitionBy("queue").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = write(dealt.groupBy("queue", "_range").agg(F.count("*").alias("_n")), "queue_counts")
    counts = counts.select("queue", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("queue", "_range").orderBy(*order))
    placed = dealt.withColumn("_here", here).join(counts, ["queue", "_range"])
    return placed.select("queue", "component", "affinity", (F.col("_before") + F.col("_here")).cast("int").alias("place"))
