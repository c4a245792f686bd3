"""What viewers and job lists ask for."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_graph(
    nodes: DataFrame,
    links: DataFrame,
    degree: DataFrame,
    statuses: list[str] | None = None,
    least_degree: int = 0,
    kinds: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes by status ('' counts as active) and degree, and the links of some kinds between them."""
    n = filter_nodes(nodes, degree, statuses, least_degree)
    keep = n.select("agent_id", "id")
    seen = links if kinds is None else links.filter(F.col("kind").isin(kinds))
    seen = seen.join(
        keep.withColumnRenamed("id", "source_id"),
        ["agent_id", "source_id"],
        "left_semi",
    ).join(keep.withColumnRenamed("id", "target_id"), ["agent_id", "target_id"], "left_semi")
    return n, seen


def filter_nodes(nodes: DataFrame, degree: DataFrame, statuses: list[str] | None = None, least_degree: int = 0) -> DataFrame:
    """The nodes of filter_graph."""
    n = nodes.join(degree, ["agent_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if statuses is not None:
        n = n.filter(F.when(F.coalesce("status", F.lit("")) == "", "active").otherwise(F.col("status")).isin(statuses))
    return n.filter(F.col("degree") >= least_degree)


def find_title(nodes: DataFrame, text: str) -> DataFrame:
    """The first node of each agent, by id, whose title holds the text, case ignored."""
    hit = nodes.filter(F.contains(F.lower("title"), F.lit(text.lower())))
    return hit.groupBy("agent_id").agg(F.min_by(F.struct("id", "title"), "id").alias("n")).select("agent_id", "n.*")


def all_archived(pages: DataFrame, unit: list[str]) -> DataFrame:
    """Whether no page of a unit is active."""
    return pages.groupBy(*unit).agg(F.bool_and(~F.col("status").isin("", "active")).alias("all_archived"))


def visible_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    a, b = nodes.groupBy("agent_id").agg(F.count("*").alias("nodes")), links.groupBy("agent_id").agg(F.count("*").alias("links"))
    return a.join(b, "agent_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def pack_communities(members: DataFrame) -> DataFrame:
    """Circles of communities (agent_id, community, kind) without overlap: the largest in the middle, each next one at the first free place of a
    spiral around it: agent_id, community, x, y, radius. Placing is sequential, on one row per community."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    sizes = members.groupBy("agent_id", "community").agg(
        F.count("*").alias("n"),
        F.greatest(7 * F.sqrt(n("interest_point")), 9 * F.sqrt(n("wiki_page"))).alias("radius"),
    )

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        import math

        rows, done = frame.sort_values(["n", "community"], ascending=[False, True]), []
        for r in rows.itertuples():
            step = 0
            while True:
                distance, angle = 4.0 * math.sqrt(step), step * 0.5
                x, y = distance * math.cos(angle), distance * math.sin(angle)
                if all(math.hypot(x - a, y - b) >= r.radius + c for _, a, b, c in done):
                    break
                step += 1
            done.append((r.community, x, y, r.radius))
        return pd.DataFrame([(frame["agent_id"].iloc[0], *d) for d in done], columns=["agent_id", "community", "x", "y", "radius"])

    return sizes.groupBy("agent_id").applyInPandas(place, "agent_id string, community long, x double, y double, radius double")


#: Job states, and those that may follow (fixed values).
NEXT_STATE = {"": {"queued"}, "queued": {"running"}, "running": {"done", "failed"}, "done": set(), "failed": set()}


def job_states(changes: DataFrame) -> DataFrame:
    """The state of each job (agent_id, id) after changes (seq, status, at), those that may not follow left out; done_at only where it is terminal."""
    allowed = F.create_map(*[x for s, after in NEXT_STATE.items() for x in (F.lit(s), F.array(*[F.lit(a) for a in sorted(after)]).cast("array<string>"))])
    lists = changes.groupBy("agent_id", "id").agg(F.sort_array(F.collect_list(F.struct("seq", "status", "at"))).alias("x"))
    begin = F.struct(F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("at"))
    last = F.aggregate(
        "x",
        begin,
        lambda s, c: F.when(
            F.array_contains(F.element_at(allowed, s.status), c.status),
            F.struct(c.status.alias("status"), c.at.cast("timestamp").alias("at")),
        ).otherwise(s),
    )
    out = lists.select("agent_id", "id", last.alias("s")).select("agent_id", "id", "s.status", "s.at")
    return out.select("agent_id", "id", "status", F.when(F.col("status").isin("done", "failed"), F.col("at")).alias("done_at"))


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and body: the other columns as JSON."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("body"))


def hit_titles(hits: DataFrame) -> DataFrame:
    return hits.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "id"))


def related_pages(explicit: DataFrame, hits: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """Pages to review a draft against: the one named first, then the best hits, pages only, each once: q, id, place."""
    every = explicit.select("q", "agent_id", "id", F.lit(0).alias("o")).unionByName(
        hits.filter(F.col("rank") <= most).select("q", "agent_id", "id", F.col("rank").alias("o")),
    )
    real = every.join(pages.select("agent_id", "id"), ["agent_id", "id"], "left_semi").groupBy("q", "agent_id", "id").agg(F.min("o").alias("o"))
    return real.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy("o", "id")).alias("place"))


class Remembered:
    """A bounded map on the driver: what was used longest ago goes first; entries older than `seconds` count as gone."""

    def __init__(self, size: int, seconds: float | None, clock: Callable[[], float]):
        self.size, self.seconds, self.clock, self.rows = size, seconds, clock, OrderedDict()

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        if key in self.rows and (self.seconds is None or self.clock() - self.rows[key][0] < self.seconds):
            self.rows.move_to_end(key)
            return self.rows[key][1]
        self.rows.pop(key, None)
        value = make()
        self.rows[key] = (self.clock(), value)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)
        return value
