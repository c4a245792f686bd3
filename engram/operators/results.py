"""What clients get of entries: result structs, references, cache keys, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import truncate_utf8
from engram.operators.graph import first_edge, resolve_replacements
from engram.operators.lookups import edges_of



def entry_results(points: DataFrame, pages: DataFrame, claims: DataFrame, max_body: int = 0) -> DataFrame:
    """Entries as clients see them: agent_id, id, kind, title, body (cut to max_body bytes; 0: whole), status, subjective, evidence, confidence, reliability,
    freshness, claims. A point's body is its summary; a page has its claims by id, and its freshness is unknown."""
    p = points.select(
        "agent_id", "id", F.lit("interest_point").alias("kind"), F.col("name").alias("title"), truncate_utf8("summary", max_body).alias("body"), "status", "subjective",
        "evidence", "confidence", F.col("reliability_status").alias("reliability"), F.col("freshness_level").alias("freshness"),
    )
    item = F.struct("id", "text", "status", "confidence")
    by_page = claims.groupBy("agent_id", F.col("page_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("claims"))
    w = pages.select(
        "agent_id",
        "id",
        F.lit("wiki_page").alias("kind"),
        "title",
        truncate_utf8("body_md", max_body).alias("body"),
        "status",
        F.lit("unknown").alias("freshness"),
    )
    w = w.join(by_page, ["agent_id", "id"], "left")
    none = F.array().cast("array<struct<id:string,text:string,status:string,confidence:double>>")
    return p.unionByName(w, allowMissingColumns=True).withColumn("claims", F.coalesce("claims", none))


def replacement_refs(starts: DataFrame, edges: DataFrame, points: DataFrame, pages: DataFrame) -> DataFrame:
    """What stands for archived points (agent_id, id): its successor's page if it has one, else the successor: agent_id, id, replacement (struct of kind, id, title,
    status)."""
    found = resolve_replacements(starts, edges, points).select("agent_id", "id", "replacement")
    of = first_edge(edges, "has_page").select("agent_id", F.col("source_id").alias("replacement"), F.col("target_id").alias("_page"))
    live = pages.filter(F.col("status").isin("", "active")).select(
        "agent_id",
        F.col("id").alias("_page"),
        F.struct(F.lit("wiki_page").alias("kind"), "id", "title", "status").alias("_w"),
    )
    own = points.select(
        "agent_id",
        F.col("id").alias("replacement"),
        F.struct(F.lit("interest_point").alias("kind"), "id", F.col("name").alias("title"), "status").alias("_p"),
    )
    rows = found.join(own, ["agent_id", "replacement"], "left").join(of, ["agent_id", "replacement"], "left").join(live, ["agent_id", "_page"], "left")
    return rows.select("agent_id", "id", F.coalesce("_w", "_p").alias("replacement"))


def first_visible(results: DataFrame, visible: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (reader, id) with the first of the reader's namespaces (visible: reader, ns, ord) that has such an entry, points before pages."""
    rows = asked.join(visible.select("reader", F.col("ns").alias("agent_id"), "ord"), "reader").join(results, ["agent_id", "id"])
    columns = [c for c in rows.columns if c not in ("reader", "id", "ord")]
    best = rows.groupBy("reader", "id").agg(F.min_by(F.struct(*columns), F.struct("ord", "kind")).alias("r"))
    return best.select("reader", "id", "r.*")


def with_edges(results: DataFrame, edges: DataFrame, points: DataFrame, pages: DataFrame) -> DataFrame:
    """results (agent_id, id, ...) with outlinks and backlinks: arrays of struct<id, title, kind, weight>, the heaviest first."""
    near = edges_of(results, edges, points, pages)
    ref = F.struct(F.col("far").alias("id"), "title", "kind", "weight")
    of = lambda d: F.transform(F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.struct("place", ref.alias("ref"))))), lambda x: x.ref)
    lists = near.groupBy("agent_id", "id").agg(of("out").alias("outlinks"), of("back").alias("backlinks"))
    none = F.array().cast("array<struct<id:string,title:string,kind:string,weight:double>>")
    out = results.join(lists, ["agent_id", "id"], "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("outlinks", "backlinks")})


def review_pages(pages: DataFrame) -> DataFrame:
    """What a reviewer sees of pages."""
    return pages.select("agent_id", "id", "title", F.col("body_md").alias("body"), "status", "tags", "sources")


def own_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs that requests (agent_id, id) may see: their agent has to be the one that asks."""
    return requests.select("agent_id", "id").distinct().join(jobs, ["agent_id", "id"])


def recall_key(agent: Column, query: Column, top_k: Column, wiki: Column, min_score: Column, after: Column, before: Column, days: Column) -> Column:
    """One text for each different recall request; times in UTC, missing ones left out."""
    at = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}="), F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(";")), F.lit(""))
    settings = F.concat(
        F.lit("topk="),
        top_k.cast("string"),
        F.lit(";wiki="),
        wiki.cast("string"),
        F.lit(";minscore="),
        F.format_string("%.4f", min_score.cast("double")),
        F.lit(";"),
    )
    return F.concat_ws("\0", agent, query, F.concat(settings, at("after", after), at("before", before), F.lit("days="), days.cast("string")))


def embed_key(model: Column, dimensions: Column, text: Column) -> Column:
    """One text for each embedding: another model, dimension or content has another one."""
    return F.concat_ws("\0", model, dimensions.cast("string"), F.sha2(text, 256))


def push_state(pushes: DataFrame) -> DataFrame:
    """What a client remembers of its pushes (agent_id, session_id, fingerprint, received_at), as one JSON object per agent: the newest fingerprint by session."""
    last = pushes.groupBy("agent_id", "session_id").agg(F.max_by("fingerprint", F.struct("received_at", "fingerprint")).alias("fingerprint"))
    entries = F.sort_array(F.collect_list(F.struct("session_id", "fingerprint")))
    return last.groupBy("agent_id").agg(F.to_json(F.map_from_entries(entries)).alias("state"))


def read_state(states: DataFrame) -> DataFrame:
    """The rows of push_state's objects: agent_id, session_id, fingerprint; anything that is no such object gives none."""
    return states.select("agent_id", F.explode(F.from_json("state", "map<string,string>")).alias("session_id", "fingerprint"))


#: Status of an answer by what went wrong; anything else is the server's fault.
STATUS = {"bad": 400, "forbidden": 403, "missing": 404, "busy": 429}


def error_body(what: Column, reason: Column) -> list[Column]:
    """status and body ({"error": reason}) of an answer that is an error."""
    status = F.coalesce(*[F.when(what == k, F.lit(v)) for k, v in STATUS.items()], F.lit(500))
    return [status.alias("status"), F.to_json(F.struct(F.coalesce(reason, F.lit("")).alias("error"))).alias("body")]
