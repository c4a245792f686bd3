"""The chain from a pushed session to stored points, edges and pages; many agents at once, one session of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import Config
from engram.functions.coerce import clamp_confidence, event_time
from engram.functions.text import candidate_text, dialog_segment, hash_id, strip_fence
from engram.operators import graph as G
from engram.operators import vectors as K
from engram.plans import consolidate as P
from engram.plans import session as S
from engram.schemas import VERDICTS
from engram.sources.transcripts import explode_transcripts

Write = Callable[[DataFrame, str], DataFrame]
Ask = Callable[[DataFrame], DataFrame]

#: The page drafts that a model answers with.
DRAFT = (
    "struct<id:string,page_type:string,title:string,content:string,status:string,tags:array<string>,sources:array<string>,"
    "claims:array<struct<text:string,status:string,confidence:double>>>"
)
NONE = "array<string>"


def oldest_unprocessed(transcripts: DataFrame) -> DataFrame:
    """Of each agent the unprocessed session that was received first: sessions of one agent are processed one after the other."""
    first = F.row_number().over(Window.partitionBy("agent_id").orderBy("received_at", "session_id"))
    return transcripts.filter("processed_at is null").withColumn("_n", first).filter("_n = 1").drop("_n")


def extract(sessions: DataFrame, ask: Ask, config: Config) -> DataFrame:
    """Candidates of sessions: agent_id, session_id, ord, topic, reason, confidence, subjective, tags, start, end, worthy, event_time (the session's date,
    else when it was received)."""
    key = ["agent_id", "session_id"]
    found = S.analyze(explode_transcripts(sessions, key, strict=False), ask, config, key)
    return found.join(sessions.select(*key, event_time("session_date", "received_at").alias("event_time")), key)


def merge_candidates(candidates: DataFrame, ask: Ask, embed: Ask, config: Config, write: Write) -> DataFrame:
    """Candidates after similar ones were merged, as points to be: pid (agent and id), agent_id, id, ord, topic, reason, confidence, tags, subjective, start, end,
    worthy, event_time, session_id, v. Merged ones are embedded again; they keep the session's event time."""
    text = candidate_text("topic", "reason").alias("text")
    vectors = write(embed(candidates.select("agent_id", "ord", text)).select("agent_id", "ord", "v"), "candidate_vectors")
    plain = candidates.select("agent_id", "ord", "topic", "reason", "confidence", "tags")
    merged = S.merge_similar(plain, vectors, ask, config.fork.cluster_sim, write).drop("cluster", "origin")
    own = candidates.select("agent_id", "topic", "subjective", "start", "end", "worthy", "ord").dropDuplicates(["agent_id", "topic"])
    of_session = candidates.groupBy("agent_id").agg(F.min("event_time").alias("event_time"), F.min("session_id").alias("session_id"))
    points = merged.join(own, ["agent_id", "topic"], "left").join(of_session, "agent_id").withColumn("id", hash_id("topic"))
    points = points.withColumn("pid", F.concat_ws("/", "agent_id", "id")).withColumn("ord", F.coalesce("ord", F.xxhash64("topic")))
    points = points.withColumns(
        {"subjective": F.coalesce("subjective", F.lit(False)), "start": F.coalesce("start", F.lit(0)), "end": F.coalesce("end", F.lit(0))},
    )
    once = points.dropDuplicates(["agent_id", "id"])
    return write(embed(once.withColumn("text", text)).drop("text"), "points")


def relate(points: DataFrame, vectors: DataFrame, config: Config, write: Write, k: int = 20) -> dict[str, DataFrame]:
    """points as components within their agent, and what of the agent's history they are like: members (pid, component, size), links (agent_id, pid, hist, sim)."""
    mine = points.select("agent_id", F.col("pid").alias("id"), "ord", "v")
    pairs = K.similar_links(mine, config.fork.similarity_merge, strict=True, scope=["agent_id"])
    members = write(G.group_points(mine, pairs, write).withColumnRenamed("id", "pid"), "members")
    history = vectors.select("agent_id", "id", F.xxhash64("id").alias("ord"), "kind", F.col("embedding").alias("v"))
    near = K.top_k(mine, history, k, scope=["agent_id"]).filter((F.col("kind") == "interest_point") & (F.col("score") > config.fork.hist_sim))
    links = write(near.select("agent_id", F.col("q").alias("pid"), F.col("id").alias("hist"), F.col("score").alias("sim")), "links")
    return {"members": members, "links": links}


def adjudication_prompt(members: Column, history: Column) -> Column:
    """Asks what becomes of a component's members and the points they are like."""
    return F.concat(
        F.lit("Decide for each new topic: merge it into a stored point, keep it, or archive a stored point it replaces. Answer as JSON with decisions"),
        F.lit(" (source_topic, action, target_id, merged, updates) and contradictions (left, right, description).\nNew:\n"),
        F.array_join(members, "\n"), F.lit("\nStored:\n"), F.array_join(history, "\n"),
    )


def ask_adjudication(points: DataFrame, related: dict[str, DataFrame], stored: DataFrame, ask: Ask, write: Write) -> dict[str, DataFrame]:
    """Verdicts on the components that have several members or a history: members, decisions and contradictions as P.adjudicate takes them,
    and isolated points. A component whose answer is missing or is no JSON has no decisions, so it is void there."""
    rows = points.join(related["members"], "pid")
    linked = related["links"].select("pid").distinct().withColumn("_linked", F.lit(True))
    rows = rows.join(linked, "pid", "left").withColumn("_any", F.max(F.coalesce("_linked", F.lit(False))).over(Window.partitionBy("component")))
    rows = write(rows.withColumn("isolated", (F.col("size") == 1) & ~F.col("_any")).drop("_linked", "_any"), "components")
    members = rows.filter("not isolated")
    history = related["links"].join(members.select("pid", "component"), "pid").select("agent_id", "component", "hist").distinct()
    known = history.join(stored.select("agent_id", F.col("id").alias("hist"), "name", "summary"), ["agent_id", "hist"])
    told = known.groupBy("component").agg(F.sort_array(F.collect_list(F.concat_ws(" | ", "hist", "name", "summary"))).alias("h"))
    asked = members.groupBy("agent_id", "component").agg(F.sort_array(F.collect_list(F.concat_ws(" | ", "topic", "reason"))).alias("m"))
    prompt = adjudication_prompt(F.col("m"), F.coalesce("h", F.array().cast(NONE)))
    answers = write(ask(asked.join(told, "component", "left").select("agent_id", "component", prompt.alias("prompt"))), "adjudication_answers")
    read = answers.select("agent_id", "component", F.from_json(strip_fence("answer"), VERDICTS["adjudication"]).alias("a"))
    topic = lambda m: F.coalesce(m.topic, m["name"])
    reason = lambda m: F.coalesce(m.reason, m.summary)
    d = read.select("agent_id", "component", F.explode("a.decisions").alias("d")).select("agent_id", "component", "d.*")
    update = lambda u: F.struct(u.target_id.alias("target_id"), topic(u.merged).alias("topic"), reason(u.merged).alias("reason"), clamp_confidence(u.merged.confidence).alias("confidence"))
    no_updates = F.array().cast("array<struct<target_id:string,topic:string,reason:string,confidence:double>>")
    decisions = d.select(
        "agent_id", "component", "source_topic", F.lower(F.trim("action")).alias("action"), "target_id",
        F.coalesce(topic(F.col("merged")), F.col("source_topic")).alias("topic"), F.coalesce(reason(F.col("merged")), F.lit("")).alias("reason"),
        clamp_confidence("merged.confidence").alias("confidence"), F.coalesce("merged.tags", F.array().cast(NONE)).alias("tags"),
        F.coalesce(F.transform("updates", update), no_updates).alias("updates"),
    )
    c = read.select("agent_id", "component", F.explode("a.contradictions").alias("c")).select("agent_id", "component", "c.*")
    return {"members": members, "decisions": decisions, "contradictions": c, "history": history, "isolated": rows.filter("isolated")}


def changes_of(verdicts: dict[str, DataFrame], stored: DataFrame, now: Column) -> DataFrame:
    """All changes of points: the adjudicated ones, and isolated points as created."""
    m = verdicts["members"].select("agent_id", "component", "topic", "reason", "confidence", "tags", "event_time")
    changed = P.adjudicate(m, verdicts["decisions"], stored, now)
    alone = verdicts["isolated"].select(
        "agent_id", "id", F.lit("create").alias("action"), F.col("topic").alias("name"), F.col("reason").alias("summary"), F.col("confidence").alias("importance"),
        F.coalesce("tags", F.array().cast(NONE)).alias("keywords"), F.lit(1).alias("seen_count"), "event_time", F.lit(False).alias("void"),
    )
    return changed.unionByName(alone)


def page_prompt(points: Column, related: Column, dialog: Column) -> Column:
    return F.concat(
        F.lit("Write one page about these points as JSON with id, page_type, title, content, status, tags, sources and claims.\nPoints:\n"),
        F.array_join(points, "\n"), F.lit("\nRelated entries: "), F.array_join(related, ", "), F.lit("\nDialogue:\n"), dialog,
    )


def draft_pages(survivors: DataFrame, sessions: DataFrame, related: DataFrame, ask: Ask, config: Config, write: Write) -> DataFrame:
    """survivors (agent_id, id, name, summary, v, wiki_worthy, start, end, event_time) as page writes, one for each unit of similar ones: agent_id, DRAFT's fields and
    points. related: what S.related_entries finds. A unit whose answer fails gives no page."""
    good = survivors.filter(F.coalesce("wiki_worthy", F.lit(True))).withColumn("pid", F.concat_ws("/", "agent_id", "id"))
    vectors = good.filter("v is not null").select("agent_id", F.col("pid").alias("id"), F.xxhash64("pid").alias("ord"), "v")
    units = G.group_points(good.select(F.col("pid").alias("id")), K.similar_links(vectors, config.wiki.group_sim, scope=["agent_id"]), write)
    rows = good.join(units.select(F.col("id").alias("pid"), "component"), "pid")
    unit = rows.groupBy("agent_id", "component").agg(
        F.sort_array(F.collect_list("id")).alias("points"), F.sort_array(F.collect_list(F.concat_ws(": ", "name", "summary"))).alias("lines"),
        F.coalesce(F.min("start"), F.lit(0)).alias("start"), F.coalesce(F.max("end"), F.lit(0)).alias("end"),
    )
    near = rows.select("pid", "agent_id", "component").join(related.withColumnRenamed("q", "pid"), ["agent_id", "pid"])
    near = near.groupBy("agent_id", "component").agg(F.array_sort(F.collect_set(F.col("id"))).alias("near"))
    unit = unit.join(near, ["agent_id", "component"], "left").withColumn("near", F.coalesce("near", F.array().cast(NONE)))
    turns = explode_transcripts(sessions, ["agent_id"], strict=False).groupBy("agent_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "role", "content"))).alias("t"),
    )
    said = dialog_segment(F.transform("t", lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))), F.col("start"), F.col("end"))
    prompts = unit.join(turns, "agent_id", "left").select(
        "agent_id",
        "component",
        "points",
        page_prompt(F.col("lines"), F.col("near"), F.coalesce(said, F.lit(""))).alias("prompt"),
    )
    answers = write(ask(prompts).select("agent_id", "points", "answer"), "page_answers")
    draft = answers.select("agent_id", "points", F.from_json(strip_fence("answer"), DRAFT).alias("p")).select("agent_id", "p.*", "points")
    return _whole(draft)


def _whole(draft: DataFrame) -> DataFrame:
    """Drafts with an id and a title, lists never null."""
    lists = {c: F.coalesce(c, F.array().cast(kind)) for c, kind in draft.dtypes if kind.startswith("array")}
    some = draft.filter(F.coalesce(F.trim("id"), F.lit("")) != "").withColumns(lists)
    return some.withColumns(
        {
            "title": F.coalesce("title", "id"),
            "content": F.coalesce("content", F.lit("")),
            "page_type": F.coalesce("page_type", F.lit("")),
            "status": F.coalesce("status", F.lit("")),
        },
    )


def reconcile(seeds: DataFrame, edges: DataFrame, pages: DataFrame, ask: Ask, config: Config) -> DataFrame:
    """Page writes that a model answers with when it is shown the pages around seeds (agent_id, id), batch by batch."""
    batches = S.reconcile_batches(seeds, edges, pages, config).join(pages.select("agent_id", "id", "title", "body_md"), ["agent_id", "id"])
    shown = batches.groupBy("agent_id", "batch_no").agg(
        F.sort_array(
            F.collect_list(F.struct("hops", "id", F.concat_ws("\n", F.concat(F.lit("# "), "id"), "title", "body_md").alias("text"))),
        ).alias("x"),
    )
    prompt = F.concat(
        F.lit(
            "Pages near these have changed. Answer with the ones to rewrite, as a JSON array of id, page_type, title, content, status, tags, sources and claims.\n",
        ),
        F.array_join(F.transform("x", lambda t: t.text), "\n---\n"),
    )
    answers = ask(shown.select("agent_id", "batch_no", prompt.alias("prompt")))
    rows = answers.select(
        "agent_id",
        F.explode(F.from_json(strip_fence("answer"), f"array<{DRAFT}>")).alias("p"),
    ).select("agent_id", "p.*", F.array().cast(NONE).alias("points"))
    # Only pages that were shown may be written.
    from engram.functions.text import normalize_id

    return _whole(rows).withColumn("id", normalize_id("id")).join(batches.select("agent_id", "id").distinct(), ["agent_id", "id"], "left_semi")
