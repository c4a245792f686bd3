"""Retrieval for many queries at once: search, fallbacks, filters, substitution, grading, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import keyword_match, render_line
from engram.operators.folds import best_claim
from engram.operators.graph import first_edge, resolve_replacements
from engram.sources.postings import page_bodies, point_bodies

#: Score of hits found by keywords.
KEYWORD_SCORE = 0.5


def point_passes() -> Column:
    return F.col("status") != "archived"


def page_passes() -> Column:
    return F.col("status").isin("", "active")


def keyword_hits(queries: DataFrame, entries: DataFrame, k: int, order: list[Column], status: Column | None = None) -> DataFrame:
    """queries: q, agent_id, text; entries: agent_id, id, kind, body, ...: the first k entries by `order` that a query matches, of these
    the ones that pass `status` (the cut comes first): q, agent_id, id, kind, score, place."""
    return cut_hits(entries.join(queries, "agent_id").filter(keyword_match("body", "text")), k, order, status)


def cut_hits(matches: DataFrame, k: int, order: list[Column], status: Column | None = None) -> DataFrame:
    """Of matches (q, agent_id, id, kind, ...) the first k by `order` of each query, and of these the ones that pass `status`: q, agent_id, id, kind, score, place."""
    rank = F.row_number().over(Window.partitionBy("q", "agent_id").orderBy(*order))
    cut = matches.withColumn("place", rank).filter(F.col("place") <= k)
    if status is not None:
        cut = cut.filter(status)
    return cut.select("q", "agent_id", "id", "kind", F.lit(KEYWORD_SCORE).alias("score"), "place")


def full_text_fallback(queries: DataFrame, points: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Points by importance (not archived), then pages by update (active), together at most k: q, agent_id, id, kind, score, place."""
    a = keyword_hits(queries, point_bodies(points), k, [F.col("importance").desc(), F.col("id")], point_passes())
    b = keyword_hits(queries, page_bodies(pages), k, [F.col("updated_at").desc(), F.col("id")], page_passes())
    return points_then_pages(a, b, k)


def points_then_pages(points: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Hits of points, then those of pages, together at most k of a query."""
    a, b = points.withColumn("part", F.lit(1)), pages.withColumn("part", F.lit(2))
    rank = F.row_number().over(Window.partitionBy("q", "agent_id").orderBy("part", "place"))
    return a.unionByName(b).withColumn("place", rank).filter(F.col("place") <= k).drop("part")


def cascade(*tiers: DataFrame) -> DataFrame:
    """Hits (q, agent_id, id, kind, score, place) of the first tier that has any for a query and agent; tiers are never blended."""
    every = None
    for i, t in enumerate(tiers, 1):
        t = t.select("q", "agent_id", "id", "kind", "score", "place", F.lit(i).alias("tier"))
        every = t if every is None else every.unionByName(t)
    first = F.min("tier").over(Window.partitionBy("q", "agent_id"))
    return every.withColumn("_t", first).filter("tier = _t").drop("_t")


def event_times(hits: DataFrame, points: DataFrame, pages: DataFrame) -> DataFrame:
    """hits with event_time: a point's, else a page's."""
    a = points.select("agent_id", "id", F.col("event_time").alias("_a"))
    b = pages.select("agent_id", "id", F.col("event_time").alias("_b"))
    return hits.join(a, ["agent_id", "id"], "left").join(b, ["agent_id", "id"], "left").withColumn("event_time", F.coalesce("_a", "_b")).drop("_a", "_b")


def filter_hits(
    hits: DataFrame,
    min_score: float = 0.3,
    include_wiki: bool = True,
    after: Column | None = None,
    before: Column | None = None,
    now: Column | None = None,
    days: int = 0,
) -> DataFrame:
    """What recall drops after its top k: low scores (compared in single precision; a min_score of 0 or less drops none), pages if they aren't
    wanted, and, only if a bound is set, hits outside [after, before] or without event time. days moves after to now - days if that is later."""
    keep = F.lit(True)
    if min_score > 0:
        keep = keep & (F.col("score").cast("float") >= F.lit(min_score).cast("float"))
    if not include_wiki:
        keep = keep & (F.col("kind") != "wiki_page")
    if days > 0:
        since = now - F.expr(f"interval {int(days)} days")
        after = since if after is None else F.greatest(after, since)
    if after is not None:
        keep = keep & F.coalesce(F.col("event_time") >= after, F.lit(False))
    if before is not None:
        keep = keep & F.coalesce(F.col("event_time") <= before, F.lit(False))
    return hits.filter(keep)


def visible_namespaces(readers: DataFrame, shared: DataFrame) -> DataFrame:
    """Namespaces a reader sees, its own first, each once, '' left out: reader, ns, ord. shared: reader, ns, ord (from 1)."""
    own = readers.select("reader", F.col("reader").alias("ns"), F.lit(0).alias("ord"))
    every = own.unionByName(shared.select("reader", "ns", "ord")).filter("ns != ''")
    first = every.groupBy("reader", "ns").agg(F.min("ord").alias("ord"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("reader").orderBy("ord", "ns")) - 1)


def rerank(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several namespaces (q, agent_id, id, score, ns_ord, place) as one list: each (agent_id, id) once, by its first place; best score first, ties by
    namespace and place; at most k."""
    once = F.row_number().over(Window.partitionBy("q", "agent_id", "id").orderBy("ns_ord", "place"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "ns_ord", "place", "agent_id", "id"))
    return hits.withColumn("_n", once).filter("_n = 1").drop("_n").withColumn("rank", best).filter(F.col("rank") <= k)


def substitute(hits: DataFrame, edges: DataFrame, points: DataFrame, pages: DataFrame, dedupe: bool = False) -> DataFrame:
    """hits with archived points replaced by what follows them, the score kept: new_id, new_kind (its page if it has one), hops. Archived ones
    without successor, and hits whose entry is gone, are dropped. dedupe: each new_id once per query, the best score."""
    p = points.select("agent_id", "id", F.col("status").alias("_ps"))
    w = pages.select("agent_id", "id", F.col("status").alias("_ws"))
    known = hits.join(p, ["agent_id", "id"], "left").join(w, ["agent_id", "id"], "left")
    live = (F.col("kind") == "interest_point") & (F.col("_ps") != "archived") | (F.col("kind") == "wiki_page") & F.col("_ws").isin("", "active")
    direct = known.filter(live).select(*hits.columns, F.col("id").alias("new_id"), F.col("kind").alias("new_kind"), F.lit(0).alias("hops"))
    gone = known.filter(~live & (F.col("_ps").isNotNull() | F.col("_ws").isNotNull())).select(*hits.columns)
    # A page stands for the point that has it.
    backing = edges.filter("kind = 'has_page'").groupBy("agent_id", F.col("target_id").alias("id")).agg(
        F.min_by("source_id", F.struct(-F.col("weight"), F.col("source_id"))).alias("_point"),
    )
    gone = gone.join(backing, ["agent_id", "id"], "left").withColumn("_start", F.when(F.col("kind") == "wiki_page", F.col("_point")).otherwise(F.col("id")))
    starts = gone.filter("_start is not null").select("agent_id", F.col("_start").alias("id")).distinct()
    found = resolve_replacements(starts, edges, points).withColumnRenamed("id", "_start")
    page = first_edge(edges, "has_page").select("agent_id", F.col("source_id").alias("replacement"), F.col("target_id").alias("_page"))
    page = page.join(pages.filter(F.col("status").isin("", "active")).select("agent_id", F.col("id").alias("_page")), ["agent_id", "_page"], "left_semi")
    moved = gone.join(found, ["agent_id", "_start"]).join(page, ["agent_id", "replacement"], "left")
    kind = F.when(F.col("_page").isNotNull(), "wiki_page").otherwise("interest_point")
    moved = moved.select(*[F.col(c) for c in hits.columns], F.coalesce("_page", "replacement").alias("new_id"), kind.alias("new_kind"), "hops")
    out = direct.unionByName(moved)
    if dedupe:
        w = Window.partitionBy("q", "agent_id", "new_id").orderBy(F.col("score").desc(), "hops", "id")
        out = out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return out


def grade(hits: DataFrame, points: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """hits with title, confidence, reliability, freshness: a point's own, a page's by its best claim (none: 0, unknown, unknown).
    Hits whose entry is gone are dropped."""
    p = points.select(
        "agent_id",
        "id",
        F.lit("interest_point").alias("kind"),
        F.col("name").alias("title"),
        "confidence",
        F.col("reliability_status").alias("reliability"),
        F.col("freshness_level").alias("freshness"),
    )
    best = best_claim(claims).select(
        "agent_id",
        F.col("page_id").alias("id"),
        "confidence",
        F.col("status").alias("reliability"),
        F.col("freshness_level").alias("freshness"),
    )
    w = pages.select("agent_id", "id", F.lit("wiki_page").alias("kind"), "title").join(best, ["agent_id", "id"], "left")
    w = w.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "reliability": F.coalesce("reliability", F.lit("unknown")),
            "freshness": F.coalesce("freshness", F.lit("unknown")),
        },
    )
    return hits.join(p.unionByName(w), ["agent_id", "id", "kind"])


def regroup_by_agent(hits: DataFrame) -> DataFrame:
    """hits (q, agent_id, rank) with place: agents in the order they come first, in each by rank."""
    first = F.min("rank").over(Window.partitionBy("q", "agent_id"))
    out = hits.withColumn("_first", first)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("_first", "rank"))).drop("_first")


def recall_text(graded: DataFrame, own: Column | None = None) -> DataFrame:
    """One text per query from graded hits (q, place, id, title, kind, event_time, confidence, reliability, freshness, agent_id): lines in order
    of place; hits of other namespaces than `own` name theirs."""
    blank = F.lit("")
    source = blank if own is None else F.when(F.col("agent_id") != own, F.col("agent_id")).otherwise(blank)
    line = render_line(
        F.col("id"),
        F.col("title"),
        F.col("kind"),
        F.col("event_time"),
        F.col("confidence"),
        F.col("reliability"),
        F.col("freshness"),
        blank,
        source,
    )
    return graded.withColumn("line", line).groupBy("q").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x.line), "").alias("text"),
    )
