"""Lookups, joins and counts over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import keyword_match


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose (agent_id, id) is asked for; ids that don't exist are left out."""
    return df.join(ids.select("agent_id", "id").distinct(), ["agent_id", "id"], "left_semi")


def search_points(points: DataFrame, query: str, limit: int) -> DataFrame:
    """By name, summary and the JSON text of keywords; the most important first. An empty query or limit gives nothing."""
    text = F.concat_ws(" ", "name", "summary", F.to_json("keywords"))
    if limit <= 0 or not query:
        return points.limit(0)
    return points.filter(keyword_match(text, F.lit(query))).orderBy(F.col("importance").desc(), "id").limit(limit)


def search_pages(pages: DataFrame, query: str, limit: int) -> DataFrame:
    """By title and body; the latest updated first."""
    if limit <= 0 or not query:
        return pages.limit(0)
    return pages.filter(keyword_match(F.concat_ws(" ", "title", "body_md"), F.lit(query))).orderBy(F.col("updated_at").desc(), "id").limit(limit)


def points_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """has_page edges of points with the page's title, null if the page is missing: agent_id, point_id, page_id, title."""
    e = edges.filter("kind = 'has_page'").select("agent_id", F.col("source_id").alias("point_id"), F.col("target_id").alias("page_id"))
    p = pages.select("agent_id", F.col("id").alias("page_id"), "title")
    return e.join(p, ["agent_id", "page_id"], "left").select("agent_id", "point_id", "page_id", "title")


def attach_claims(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """pages with claims: array of struct, by id; empty if there is none."""
    lists = claims.groupBy("agent_id", F.col("page_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("id"), "text", "status", "confidence"))).alias("claims"),
    )
    kind = "array<struct<id:string,text:string,status:string,confidence:double>>"
    return pages.join(lists, ["agent_id", "id"], "left").withColumn("claims", F.coalesce("claims", F.array().cast(kind)))


def resolve_titles(refs: DataFrame, points: DataFrame, pages: DataFrame, ref: str = "id") -> DataFrame:
    """refs with title: a point's name, else a page's title, else ''."""
    a = points.select("agent_id", F.col("id").alias(ref), F.col("name").alias("_a"))
    b = pages.select("agent_id", F.col("id").alias(ref), F.col("title").alias("_b"))
    return refs.join(a, ["agent_id", ref], "left").join(b, ["agent_id", ref], "left").withColumn("title", F.coalesce("_a", "_b", F.lit(""))).drop("_a", "_b")


def edges_of(ids: DataFrame, edges: DataFrame, points: DataFrame, pages: DataFrame) -> DataFrame:
    """Out- and backlinks of ids, heaviest first: agent_id, id, direction, far, kind, weight, title, place."""
    keys = ids.select("agent_id", "id").distinct()
    out = edges.withColumnRenamed("source_id", "id").join(keys, ["agent_id", "id"], "left_semi").select(
        "agent_id",
        "id",
        F.lit("out").alias("direction"),
        F.col("target_id").alias("far"),
        "kind",
        "weight",
    )
    back = edges.withColumnRenamed("target_id", "id").join(keys, ["agent_id", "id"], "left_semi").select(
        "agent_id",
        "id",
        F.lit("back").alias("direction"),
        F.col("source_id").alias("far"),
        "kind",
        "weight",
    )
    return placed_edges(resolve_titles(out.unionByName(back), points, pages, ref="far"))


def placed_edges(edges: DataFrame) -> DataFrame:
    """Edges (agent_id, id, direction, far, kind, weight) with their place, heaviest first."""
    w = Window.partitionBy("agent_id", "id", "direction").orderBy(F.col("weight").desc(), "far", "kind")
    return edges.withColumn("place", F.row_number().over(w))


def exclude_boards(rows: DataFrame, board_id: str, board_name: str, excluded: list[str]) -> DataFrame:
    """Rows whose board, by id or name, isn't excluded: trimmed, case ignored, blank entries and blank boards don't match."""
    blocked = [x.strip().lower() for x in excluded if x.strip()]
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return rows.filter(~(clean(board_id).isin(blocked) | clean(board_name).isin(blocked)))


def list_tags(pages: DataFrame) -> DataFrame:
    """How often each tag occurs, '' left out: agent_id, tag, n, place (n desc, tag)."""
    counts = pages.select("agent_id", F.explode("tags").alias("tag")).filter("tag != ''").groupBy("agent_id", "tag").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("agent_id").orderBy(F.col("n").desc(), "tag")))


def agent_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per agent and table, 0 where an agent has none: agent_id and a column per table."""
    parts = [df.groupBy("agent_id").agg(F.count("*").alias("n")).withColumn("t", F.lit(name)) for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = [F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).cast("long").alias(name) for name in tables]
    return every.groupBy("agent_id").agg(*sums)


def list_agents(points: DataFrame, pages: DataFrame) -> DataFrame:
    return points.select("agent_id").union(pages.select("agent_id")).filter("agent_id != ''").distinct()


def log_page(logs: DataFrame, limit: int, offset: int) -> DataFrame:
    """Newest first. A limit of 0 or less is none, and then the offset doesn't count; a negative offset is 0."""
    ordered = logs.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered if limit <= 0 else ordered.offset(max(offset, 0)).limit(limit)


def usage_by_day(events: DataFrame, ts: str, sums: dict[str, Column]) -> DataFrame:
    return events.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("date")).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])


def check_edges(writes: DataFrame, pages: DataFrame, kinds: list[str], most: int = 8) -> DataFrame:
    """Violations of edges (agent_id, source_id, pos, target_id, kind) to be written: the same columns and problem."""
    w = Window.partitionBy("agent_id", "source_id")
    known = pages.select("agent_id", F.col("id").alias("target_id")).distinct().withColumn("_there", F.lit(True))
    rows = writes.withColumn("_n", F.count("*").over(w)).withColumn(
        "_dup",
        F.row_number().over(Window.partitionBy("agent_id", "source_id", "kind", "target_id").orderBy("pos")),
    ).join(known, ["agent_id", "target_id"], "left")
    return edge_problems(rows, kinds, most)


def edge_problems(rows: DataFrame, kinds: list[str], most: int = 8) -> DataFrame:
    """check_edges where it is known, with each edge, how many its source has (_n), its place among equal ones (_dup), and whether its target exists (_there, null if not)."""
    problems = F.array_compact(F.array(
        F.when(F.col("_n") > most, F.lit("too many edges")),
        F.when(~F.col("kind").isin(kinds), F.lit("unknown kind")),
        F.when(F.col("_dup") > 1, F.lit("repeated edge")),
        F.when(F.col("target_id") == F.col("source_id"), F.lit("edge to itself")),
        F.when(F.col("_there").isNull(), F.lit("no such page")),
    ))
    return rows.select("agent_id", "source_id", "pos", "target_id", "kind", F.explode(problems).alias("problem"))


def skipped_points(units: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Worthy points (agent_id, unit, id, wiki_worthy) none of whose pages was touched; nothing for agents without touched pages."""
    pages = edges.filter("kind = 'has_page'").select("agent_id", F.col("source_id").alias("id"), F.col("target_id").alias("page_id"))
    covered = pages.join(
        touched.select("agent_id", F.col("id").alias("page_id")).distinct(),
        ["agent_id", "page_id"],
        "left_semi",
    ).select("agent_id", "id").distinct()
    active = touched.select("agent_id").distinct()
    return units.filter(F.coalesce("wiki_worthy", F.lit(True))).join(active, "agent_id", "left_semi").join(covered, ["agent_id", "id"], "left_anti")


def identity_mismatches(points: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Subjective points with a touched page (agent_id, id, page_type) that is an entity or source: agent_id, id, page_id, page_type."""
    pages = edges.filter("kind = 'has_page'").select("agent_id", F.col("source_id").alias("id"), F.col("target_id").alias("page_id"))
    t = touched.filter(F.col("page_type").isin("entity", "source")).select("agent_id", F.col("id").alias("page_id"), "page_type")
    return points.filter("subjective").select("agent_id", "id").join(pages, ["agent_id", "id"]).join(t, ["agent_id", "page_id"]).select(
        "agent_id",
        "id",
        "page_id",
        "page_type",
    )


def evict_jobs(jobs: DataFrame, most: int = 1000) -> DataFrame:
    """Jobs (id, status, done_at) that stay: above `most`, the terminal ones done first go, as many as are too many."""
    excess = jobs.count() - most
    if excess <= 0:
        return jobs
    gone = jobs.filter(F.col("status").isin("done", "failed")).orderBy("done_at", "id").limit(excess).select("id")
    return jobs.join(gone, "id", "left_anti").select(*jobs.columns)


def newest_sessions(states: DataFrame, most: int = 10) -> DataFrame:
    """The sessions pushed last, per agent."""
    rank = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.col("pushed_at").desc(), F.col("session_id").desc()))
    return states.withColumn("place", rank).filter(F.col("place") <= most)
