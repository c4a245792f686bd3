"""Consolidation: candidates and verdict tables to changes of points, pages and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import hash_id, relink, truncate_utf8
from engram.operators.vectors import similar_pairs
from engram.schemas import schema


def apply_merges(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """candidates (cluster, topic, reason, confidence, tags) after merge verdicts (cluster, action, source_topics, merged): merge and compose
    give the merged one, keep its sources as they are; other actions just use up their sources; candidates that no verdict names stay."""
    named = verdicts.select("cluster", "action", F.explode("source_topics").alias("topic"))
    new = verdicts.filter(F.col("action").isin("merge", "compose")).select(
        "cluster",
        F.col("merged.topic").alias("topic"),
        F.col("merged.reason").alias("reason"),
        F.col("merged.confidence").alias("confidence"),
        F.col("merged.tags").alias("tags"),
        F.lit("merged").alias("origin"),
    )
    kept = candidates.join(named.filter("action = 'keep'").select("cluster", "topic").distinct(), ["cluster", "topic"], "left_semi")
    rest = candidates.join(named.select("cluster", "topic").distinct(), ["cluster", "topic"], "left_anti")
    columns = ["cluster", "topic", "reason", "confidence", "tags"]
    return new.unionByName(kept.select(*columns, F.lit("kept").alias("origin"))).unionByName(rest.select(*columns, F.lit("unnamed").alias("origin")))


def adjudicate(members: DataFrame, decisions: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """Changes that decisions make to an agent's points.

    members: agent_id, component, topic, reason, confidence, tags, event_time; decisions: agent_id, component, source_topic, action (merge, keep,
    archive), target_id, topic, reason, confidence, tags (the merged ones), updates (array of struct<target_id, topic, reason, confidence>).
    A component with a member that no decision names is void: its members are created as they are. merge overwrites the target in place (its id and
    first_seen_at stay, one more sighting); keep creates a point, and updates others; archive creates one and archives the target, if there is one.
    Tags: the merged ones, else the point's own, else the member's. Returns agent_id, id, action (create, update, archive), name, summary,
    importance, keywords, seen_count, event_time, void.
    """
    named = decisions.select("agent_id", "component", F.col("source_topic").alias("topic")).distinct().withColumn("_d", F.lit(1))
    state = members.join(named, ["agent_id", "component", "topic"], "left").groupBy("agent_id", "component").agg((F.count("_d") < F.count("*")).alias("void"))
    m = members.select(
        "agent_id",
        "component",
        F.col("topic").alias("source_topic"),
        F.col("tags").alias("_mt"),
        F.col("event_time").alias("_me"),
    ).dropDuplicates(["agent_id", "component", "source_topic"])
    valid = decisions.join(
        state.filter("not void").select("agent_id", "component"),
        ["agent_id", "component"],
        "left_semi",
    ).join(m, ["agent_id", "component", "source_topic"], "left")
    none = F.array().cast("array<string>")
    some = lambda a, b: F.when(F.size(F.coalesce(a, none)) > 0, a).otherwise(F.coalesce(b, none))

    def created(df: DataFrame, topic: Column, reason: Column, confidence: Column, tags: Column, at: Column, void: bool) -> DataFrame:
        return df.select(
            "agent_id",
            hash_id(topic).alias("id"),
            F.lit("create").alias("action"),
            topic.alias("name"),
            reason.alias("summary"),
            confidence.alias("importance"),
            tags.alias("keywords"),
            F.lit(1).alias("seen_count"),
            at.alias("event_time"),
            F.lit(void).alias("void"),
        )

    made = created(
        valid.filter(F.col("action").isin("keep", "archive")),
        F.col("topic"),
        F.col("reason"),
        F.col("confidence"),
        some(F.col("tags"), F.col("_mt")),
        F.col("_me"),
        False,
    )
    lost = members.join(state.filter("void").select("agent_id", "component"), ["agent_id", "component"], "left_semi")
    back = created(lost, F.col("topic"), F.col("reason"), F.col("confidence"), F.coalesce("tags", none), F.col("event_time"), True)

    merged = valid.filter("action = 'merge'").select("agent_id", "target_id", "topic", "reason", "confidence", "tags", "_mt", "_me")
    also = valid.filter("action = 'keep'").select("agent_id", F.explode("updates").alias("u"), "_mt", "_me").select(
        "agent_id",
        F.col("u.target_id").alias("target_id"),
        F.col("u.topic").alias("topic"),
        F.col("u.reason").alias("reason"),
        F.col("u.confidence").alias("confidence"),
        F.lit(None).cast("array<string>").alias("tags"),
        "_mt",
        "_me",
    )
    old = points.select(
        "agent_id",
        F.col("id").alias("target_id"),
        F.col("keywords").alias("_k"),
        F.col("seen_count").alias("_s"),
        F.col("event_time").alias("_pe"),
    )
    updates = merged.unionByName(also).join(old, ["agent_id", "target_id"], "left")
    updated = updates.select(
        "agent_id", F.col("target_id").alias("id"), F.lit("update").alias("action"), F.col("topic").alias("name"), F.col("reason").alias("summary"), F.col("confidence").alias("importance"),
        some(
            F.col("tags"),
            some(F.col("_k"), F.col("_mt")),
        ).alias("keywords"), (F.coalesce("_s", F.lit(0)) + 1).cast("int").alias("seen_count"), F.coalesce("_pe", "_me").alias("event_time"), F.lit(False).alias("void"),
    )
    ends = valid.filter("action = 'archive'").select("agent_id", F.col("target_id").alias("id")).join(points, ["agent_id", "id"])
    archived = ends.select(
        "agent_id",
        "id",
        F.lit("archive").alias("action"),
        "name",
        "summary",
        "importance",
        "keywords",
        "seen_count",
        "event_time",
        F.lit(False).alias("void"),
    )
    return made.unionByName(back).unionByName(updated).unionByName(archived)


def changed_points(changes: DataFrame, stored: DataFrame, now: Column, details: DataFrame | None = None) -> DataFrame:
    """The rows of interest_points that changes (see adjudicate) make, one per agent_id and id, with action: archiving comes last, so it prevails, then
    updates. An update starts from the stored row and replaces what the change names; an archived point changes its status only; a created one takes its
    confidence from its importance and is unknown in reliability and freshness. details: agent_id, id, further columns of created points."""
    rank = F.when(F.col("action") == "archive", 2).when(F.col("action") == "update", 1).otherwise(0)
    named = ["action", "name", "summary", "importance", "keywords", "seen_count", "event_time"]
    keyed = changes.withColumn("_o", rank).groupBy("agent_id", "id").agg(F.max_by(F.struct(*named), "_o").alias("x"))
    fields = [f for f in schema("interest_points").fields if f.name not in ("agent_id", "id")]
    rows = keyed.join(stored.select("agent_id", "id", F.struct("id", *[f.name for f in fields]).alias("o")), ["agent_id", "id"], "left")
    given: dict[str, Column] = {}
    if details is not None:
        more = [f.name for f in fields if f.name in details.columns]
        rows = rows.join(details.select("agent_id", "id", F.struct(*more).alias("d")), ["agent_id", "id"], "left")
        given = {c: F.col(f"d.{c}") for c in more}
    action = F.col("x.action")
    fresh = {
        "confidence": F.col("x.importance"), "reliability_status": F.lit("unknown"), "freshness_level": F.lit("unknown"), "first_seen_at": now,
        "subjective": F.lit(False), "source_session_ids": F.array().cast("array<string>"), "evidence": F.array(),
    }
    changed = {c: F.col(f"x.{c}") for c in named[1:]} | {"status": F.lit("active"), "last_seen_at": now, "updated_at": now}
    archived = {"status": F.lit("archived"), "updated_at": now}
    out = []
    for f in fields:
        c, old = f.name, F.col(f"o.{f.name}")
        new = F.coalesce(*[x for x in (given.get(c), fresh.get(c)) if x is not None], F.lit(None)).cast(f.dataType)
        value = F.when((action == "create") | F.col("o.id").isNull(), changed.get(c, new)).otherwise(changed.get(c, old))
        out.append(F.when(action == "archive", archived.get(c, old)).otherwise(value).cast(f.dataType).alias(c))
    return rows.select("agent_id", "id", action.alias("action"), *out)


def resolve_contradictions(sides: DataFrame, members: DataFrame, component_history: DataFrame, now: Column) -> DataFrame:
    """sides (agent_id, component, left, right, description) as rows of contradictions: a side is a historical id of its component, else a member's
    topic; pairs with an unknown or the same side are dropped. The id comes from the agent and both sides, so that all pairs are kept apart."""
    hist = component_history.select("agent_id", "component", F.col("hist").alias("_h")).distinct()
    topics = members.select("agent_id", "component", F.col("topic").alias("_t")).distinct()
    out = sides
    for side in ("left", "right"):
        h, t = hist.withColumnRenamed("_h", side).withColumn("_is", F.lit(True)), topics.withColumnRenamed("_t", side).withColumn("_named", F.lit(True))
        out = out.join(h, ["agent_id", "component", side], "left").join(t, ["agent_id", "component", side], "left")
        out = out.withColumn(f"{side}_id", F.when(F.col("_is"), F.col(side)).when(F.col("_named"), hash_id(F.col(side)))).drop("_is", "_named")
    good = out.filter("left_id is not null and right_id is not null and left_id != right_id")
    ident = hash_id(F.col("agent_id"), F.least("left_id", "right_id"), F.greatest("left_id", "right_id"))
    return good.select(ident.alias("id"), "agent_id", "left_id", "right_id", "description", F.lit("open").alias("status"), now.alias("created_at"))


def related_edges(points: DataFrame, least: float, now: Column) -> DataFrame:
    """related edges between an agent's points (agent_id, id, ord, v) of at least that cosine, which is their weight; from the earlier to the later."""
    pairs = similar_pairs(points, least, strict=False, scope=["agent_id"])
    return pairs.select(
        "agent_id",
        F.col("a").alias("source_id"),
        F.col("b").alias("target_id"),
        F.lit("related").alias("kind"),
        F.col("sim").alias("weight"),
        now.alias("created_at"),
    )


def supersede_pages(pages: DataFrame, replacements: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """pages after replacements (agent_id, old, new): old ones become superseded; pages that link to one by references, related or contradicts get
    [[old]] rewritten as [[new]]."""
    gone = replacements.select("agent_id", F.col("old").alias("id")).distinct().withColumn("_gone", F.lit(True))
    links = edges.filter(F.col("kind").isin("references", "related", "contradicts")).select(
        "agent_id",
        F.col("source_id").alias("id"),
        F.col("target_id").alias("old"),
    ).distinct()
    swaps = links.join(replacements, ["agent_id", "old"]).groupBy("agent_id", "id").agg(F.sort_array(F.collect_list(F.struct("old", "new"))).alias("_swaps"))
    body = F.aggregate("_swaps", F.col("body_md"), lambda b, s: relink(b, s.old, s.new))
    out = pages.join(gone, ["agent_id", "id"], "left").join(swaps, ["agent_id", "id"], "left")
    changed = F.col("_gone").isNotNull() | F.col("_swaps").isNotNull()
    new = {
        "status": F.when(F.col("_gone"), "superseded").otherwise(F.col("status")),
        "body_md": F.coalesce(body, "body_md"),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
    }
    return out.select(*[(new[c].alias(c) if c in new else F.col(c)) for c in pages.columns])


def write_pages(writes: DataFrame, old: DataFrame, now: Column) -> dict[str, DataFrame]:
    """page_writes (agent_id, id, page_type, title, content, status, tags, sources, points, claims) as rows for wiki_pages, edges, claims and change_log,
    and the texts to embed."""
    from engram.functions import coerce as C
    from engram.functions.text import normalize_id

    w = writes.withColumn("id", normalize_id("id")).withColumn(
        "page_type",
        C.enum("page_type", C.PAGE_TYPES, C.PAGE_TYPE_ELSE),
    ).withColumn("status", C.enum("status", C.PAGE_STATUS, C.PAGE_STATUS_ELSE))
    body = F.when(
        (F.col("page_type") == "source") & (F.size("sources") > 0),
        F.concat(F.lit("> Source sessions: "), F.array_join("sources", ", "), F.lit("\n\n"), F.col("content")),
    ).otherwise(F.col("content"))
    before = old.select("agent_id", "id", F.col("created_at").alias("_c"), F.col("event_time").alias("_e"))
    rows = w.join(before, ["agent_id", "id"], "left")
    pages = rows.select(
        "id",
        "agent_id",
        "page_type",
        "title",
        body.alias("body_md"),
        "status",
        C.cap_list("tags").alias("tags"),
        C.cap_list("sources").alias("sources"),
        F.col("_e").alias("event_time"),
        F.coalesce("_c", now).alias("created_at"),
        now.alias("updated_at"),
    )
    edges = w.select(
        "agent_id",
        F.explode("points").alias("source_id"),
        F.col("id").alias("target_id"),
        F.lit("has_page").alias("kind"),
        F.lit(1.0).alias("weight"),
        now.alias("created_at"),
    )
    claims = w.select("agent_id", F.col("id").alias("page_id"), F.explode("claims").alias("c")).select(
        hash_id("agent_id", "page_id", F.col("c.text")).alias("id"),
        "page_id",
        "agent_id",
        F.col("c.text").alias("text"),
        C.enum(F.col("c.status"), C.CLAIM_STATUS, C.CLAIM_STATUS_ELSE).alias("status"),
        C.clamp_confidence(F.col("c.confidence")).alias("confidence"),
        now.alias("updated_at"),
    )
    action = F.when(F.col("status") != "active", F.col("status")).when(F.col("_c").isNull(), "create").otherwise("update")
    log = rows.select(
        hash_id("agent_id", "id", now.cast("string")).alias("id"),
        "agent_id",
        now.alias("created_at"),
        F.lit("wiki_page").alias("entity_kind"),
        F.col("id").alias("entity_id"),
        "title",
        action.alias("action"),
    )
    texts = w.select("agent_id", "id", truncate_utf8(F.concat_ws("\n", "title", "content"), 8000, "").alias("text"))
    return {"wiki_pages": pages, "edges": edges, "claims": claims, "change_log": log, "texts": texts}


def backfill_event_time(pages: DataFrame, units: DataFrame) -> DataFrame:
    """Touched pages without event time get the earliest of their unit (agent_id, page_id, event_time)."""
    first = units.groupBy("agent_id", F.col("page_id").alias("id")).agg(F.min("event_time").alias("_u"))
    return pages.join(first, ["agent_id", "id"], "left").withColumn("event_time", F.coalesce("event_time", "_u")).drop("_u")
