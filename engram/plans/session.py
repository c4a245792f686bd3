"""From transcripts to changes: windows, extraction, merging, clustering, compilation, reconciliation.

Model answers enter as columns; everything before the prompt and after the answer is a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import Config
from engram.functions.coerce import clamp_confidence, worthy
from engram.functions.text import candidate_text, normalize_topic, strip_fence, trim_space
from engram.operators import folds as D
from engram.operators import graph as G
from engram.operators import vectors as K
from engram.operators import windows as W
from engram.plans import recall as R
from engram.plans.consolidate import apply_merges
from engram.schemas import VERDICTS
from engram.sources.transcripts import chat_role

Write = Callable[[DataFrame, str], DataFrame]


def render_windows(turns: DataFrame, window: list[str], with_tools: bool = False) -> DataFrame:
    """turns (window..., idx, role, content) as one text per window, shown turns numbered from 1, and their indices: window..., text, indices."""
    shown = W.rendered_turns(turns, window, with_tools)
    line = F.concat(F.col("number").cast("string"), F.lit(". "), chat_role(F.col("role")), F.lit(": "), F.col("content"))
    lists = shown.groupBy(*window).agg(F.sort_array(F.collect_list(F.struct("number", "idx", line.alias("line")))).alias("x"))
    return lists.select(*window, F.array_join(F.transform("x", lambda t: t.line), "\n").alias("text"), F.transform("x", lambda t: t.idx).alias("indices"))


def extraction_prompt(text: Column, known: Column | None = None) -> Column:
    """Asks for candidates; `known` are topics that are there already (second pass)."""
    start = F.lit(
        "List what is worth remembering in this dialogue as a JSON array of objects with topic, reason, confidence, tags, turn_range, subjective and wiki_worthy.\n",
    )
    again = F.lit("") if known is None else F.when(F.size(known) > 0, F.concat(F.lit("Leave out: "), F.array_join(known, "; "), F.lit("\n"))).otherwise("")
    return F.concat(start, again, F.lit("\n"), text)


def read_candidates(answers: DataFrame, window: list[str], pass_no: int = 0) -> DataFrame:
    """answers (window..., win_no, indices, answer) as candidates: ord follows pass, window and place; turn ranges are mapped to turn indices; an
    answer that is no JSON gives none."""
    read = F.from_json(strip_fence("answer"), VERDICTS["candidates"])
    rows = answers.select(*window, "win_no", "indices", F.posexplode(read).alias("pos", "c"))
    span = W.map_turn_range(F.coalesce(F.get("c.turn_range", F.lit(0)), F.lit(0)), F.coalesce(F.get("c.turn_range", F.lit(1)), F.lit(0)), F.col("indices"))
    tags = F.filter(F.transform(F.coalesce("c.tags", F.array().cast("array<string>")), trim_space), lambda t: t != "")
    order = F.lit(pass_no * 10**9).cast("long") + F.col("win_no") * 10**6 + F.col("pos")
    out = rows.select(
        *window,
        "win_no",
        order.alias("ord"),
        F.col("c.topic").alias("topic"),
        F.coalesce("c.reason", F.lit("")).alias("reason"),
        F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("c.subjective", F.lit(False)).alias("subjective"),
        tags.alias("tags"),
        span.alias("r"),
        F.col("c.wiki_worthy").alias("worthy"),
    )
    return out.select(*[c for c in out.columns if c != "r"], "r.start", "r.end")


def analyze(turns: DataFrame, ask: Callable[[DataFrame], DataFrame], config: Config, session: list[str]) -> DataFrame:
    """Candidates of sessions by the configured route. turns: session..., idx, role, content. The second pass of full2 is told the topics
    of the first, and whatever repeats one is folded into it."""
    f = config.fork
    if f.route == "prefix":
        ends = W.prefix_windows(turns, session, f.prefix_step, f.max_windows).select(*session, "win_no", "end_idx")
        windowed = turns.join(ends, session).filter(F.col("idx") <= F.col("end_idx"))
    elif f.route == "non_prefix":
        windowed = W.disjoint_windows(turns, session, f.prefix_step, f.max_windows)
    else:
        windowed = turns.withColumn("win_no", F.lit(0))
    shown = render_windows(windowed, [*session, "win_no"], with_tools=f.route in ("full", "full2"))
    first = read_candidates(ask(shown.withColumn("prompt", extraction_prompt(F.col("text")))), session)
    found = D.filter_candidates(first, [*session, "win_no"], f.min_confidence, f.max_candidates_per_window)
    if f.route == "full2":
        topics = found.groupBy(*session).agg(F.sort_array(F.collect_set(normalize_topic("topic"))).alias("known"))
        again = shown.join(topics, session, "left")
        second = read_candidates(
            ask(again.withColumn("prompt", extraction_prompt(F.col("text"), F.coalesce("known", F.array().cast("array<string>"))))),
            session,
            pass_no=1,
        )
        found = found.unionByName(D.filter_candidates(second, [*session, "win_no"], f.min_confidence, f.max_candidates_per_window))
    return D.fold_candidates(found, session)


def merge_similar(candidates: DataFrame, vectors: DataFrame, ask: Callable[[DataFrame], DataFrame], least: float, write: Write) -> DataFrame:
    """candidates (agent_id, ord, topic, reason, confidence, tags) with vectors (agent_id, ord, v): components of similar ones (over `least`) with more
    than one member get a merge verdict; all others stay. Returns agent_id, cluster, topic, reason, confidence, tags, origin."""
    named = vectors.select("agent_id", F.concat_ws("/", "agent_id", F.col("ord").cast("string")).alias("id"), "ord", "v")
    pairs = K.similar_links(named, least, strict=True, scope=["agent_id"])
    groups = write(G.group_points(named, pairs, write), "merge_groups")
    keyed = candidates.withColumn("id", F.concat_ws("/", "agent_id", F.col("ord").cast("string"))).join(groups, "id").withColumnRenamed("component", "cluster")
    many = keyed.filter("size > 1").groupBy("agent_id", "cluster").agg(
        F.sort_array(F.collect_list(F.struct("ord", candidate_text("topic", "reason").alias("t")))).alias("x"),
    )
    asked = ask(
        many.select(
            "cluster",
            F.concat(
                F.lit("Merge, compose or keep these; answer as a JSON array of action, source_topics and merged.\n"),
                F.array_join(F.transform("x", lambda t: t.t), "\n---\n"),
            ).alias("prompt"),
        ),
    )
    verdict = asked.select("cluster", F.explode(F.from_json(strip_fence("answer"), f"array<{VERDICTS['merge']}>")).alias("v"))
    v = verdict.select(
        "cluster",
        "v.action",
        "v.source_topics",
        F.struct(
            F.coalesce("v.merged.topic", "v.merged.name").alias("topic"),
            F.coalesce("v.merged.reason", "v.merged.summary").alias("reason"),
            clamp_confidence("v.merged.confidence").alias("confidence"),
            F.coalesce("v.merged.tags", F.array().cast("array<string>")).alias("tags"),
        ).alias("merged"),
    )
    out = apply_merges(keyed.select("cluster", "topic", "reason", "confidence", "tags"), v)
    return out.join(keyed.select("cluster", "agent_id").distinct(), "cluster")


def cluster_with_history(current: DataFrame, history: DataFrame, merge: float, least: float, write: Write) -> dict[str, DataFrame]:
    """current (id, ord, v) and history (id, ord, kind, v) as components: members (id, component), links to history (point, hist, sim), queues of components
    that share history, and isolated points (alone, without history)."""
    groups = write(G.group_points(current, K.similar_links(current, merge, strict=True), write), "session_groups")
    links = write(K.history_links(current, history, least), "history_links")
    members = groups.select("id", "component")
    queues = G.conflict_queues(members, links, write)
    isolated = groups.filter("size = 1").select("id").join(links.select(F.col("point").alias("id")).distinct(), "id", "left_anti")
    return {"members": members, "links": links, "queues": queues, "isolated": isolated}


def assemble_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per component: members, its history (each once) and the history of each member."""
    hist = links.groupBy(F.col("point").alias("id")).agg(F.sort_array(F.collect_set("hist")).alias("hist"))
    rows = members.join(hist, "id", "left").withColumn("hist", F.coalesce("hist", F.array().cast("array<string>")))
    return rows.groupBy("component").agg(
        F.sort_array(F.collect_list("id")).alias("members"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hist")))).alias("history"),
        F.map_from_entries(F.collect_list(F.struct("id", "hist"))).alias("member_history"),
    )


def compile_units(points: DataFrame, least: float, write: Write) -> DataFrame:
    """Worthy points (id, ord, v, wiki_worthy, start, end, event_time) as units that become one page each: components at `least` or more, and each
    isolated point: unit, ids, start, end, event_time."""
    good = points.filter(worthy("wiki_worthy"))
    groups = G.group_points(good, K.similar_links(good.filter("v is not null").select("id", "ord", "v"), least), write)
    rows = good.join(groups, "id")
    return D.dialog_span(rows, ["component"]).join(
        rows.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "component",
    ).withColumnRenamed("component", "unit")


def reconcile_batches(seeds: DataFrame, edges: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """Pages to look at again after seeds changed (agent_id, id): all within max_hops that aren't all archived, in batches: agent_id, id, hops, batch_no."""
    return reached_batches(G.bfs_hops(seeds, edges, pages, config.wiki.max_hops), pages, config)


def reached_batches(found: DataFrame, pages: DataFrame, config: Config) -> DataFrame:
    """The batches of reconcile_batches, from the pages that a walk has found: agent_id, id, hops."""
    reached = found.join(pages.select("agent_id", "id", "status"), ["agent_id", "id"])
    alive = F.max(F.col("status").isin("", "active")).over(Window.partitionBy("agent_id"))
    kept = reached.withColumn("_any", alive).filter("_any").drop("_any")
    return W.batches(kept, ["agent_id"], [F.col("hops"), F.col("id")], config.wiki.batch_size).select("agent_id", "id", "hops", "batch_no")


def related_entries(points: DataFrame, vectors: DataFrame, stored: DataFrame, pages: DataFrame, k: int = 3) -> DataFrame:
    """For each point (agent_id, id, name, v) the k entries to look at before a page is written: the nearest by vectors, itself left out; where there are none, those
    that hold its name: agent_id, q, id, kind, place."""
    own = points.select("agent_id", F.concat_ws("/", "agent_id", "id").alias("q"), "id", "name", "v")
    near = K.top_k(
        own.filter("v is not null").select("agent_id", F.col("q").alias("id"), F.xxhash64("q").alias("ord"), "v"),
        vectors,
        k + 1,
        scope=["agent_id"],
    )
    near = near.select("q", "agent_id", "id", "kind", "score", F.col("rank").alias("place"))
    words = R.full_text_fallback(own.select("q", "agent_id", F.col("name").alias("text")), stored, pages, k + 1)
    hits = R.cascade(near.filter("q != concat_ws('/', agent_id, id)"), words.filter("q != concat_ws('/', agent_id, id)"))
    place = F.row_number().over(Window.partitionBy("agent_id", "q").orderBy("place"))
    return hits.withColumn("place", place).filter(F.col("place") <= k).select("agent_id", "q", "id", "kind", "place")


def prelookup(points: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest entries of each point (agent_id, id, ord, v), itself left out."""
    near = K.top_k(points.select("agent_id", "id", "ord", "v"), vectors, k + 1, scope=["agent_id"])
    rank = F.row_number().over(Window.partitionBy("agent_id", "q").orderBy("rank"))
    return near.filter("q != id").withColumn("rank", rank).filter(F.col("rank") <= k)
