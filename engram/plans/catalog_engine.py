"""Catalogue: what the engine and its store do as a whole: commits, isolated jobs, indexes kept by writes, the tiers of retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.config import Config, Fork
from engram.engine import Engine
from engram.operators import keyword_index as Y
from engram.operators import vector_index as I
from engram.plans.fixtures import Fixtures, with_tables
from engram.plans.process import oldest_unprocessed
from engram.plans.registry import query
from engram.plans.worker import Failures, run_isolated
from engram.sources.scratch import scratch, scratch_path
from engram.streaming.ingest import accept_pushes


def _engine(fx: Fixtures, **settings: object) -> Engine:
    return Engine(fx.spark, Config(root=scratch_path(fx.spark, "catalog_engine"), **settings))


def _at(text: str):
    return F.lit(text).cast("timestamp")


#: Queries of the keyword searches: what every document whose id is divisible by 100 begins with, asked of its own agent.
_ASKED_SQL = "qs as (select cast(doc_id as varchar) as q, source as agent_id, substr(text, 1, 9) as text from documents where doc_id % 100 = 0)"


def _asked(fx: Fixtures) -> DataFrame:
    d = fx.table("documents").filter("doc_id % 100 = 0")
    return d.select(F.col("doc_id").cast("string").alias("q"), F.col("source").alias("agent_id"), F.substring("text", 1, 9).alias("text"))


def _keyword_sql(points: str) -> str:
    return f"""p as (select q, agent_id, id, 'interest_point' as kind, status, row_number() over (partition by q order by importance desc, id) as place from qs join {points} using (agent_id)
          where text != '' and lower(name || ' ' || summary || ' ' || '["' || lang || '","' || source || '"]') like '%' || lower(text) || '%'),
    w as (select q, agent_id, id, 'wiki_page' as kind, status, row_number() over (partition by q order by updated_at desc, id) as place from qs join wpages using (agent_id) where text != '' and lower(title || ' ' || body_md) like '%' || lower(text) || '%'),
    u as (select q, id, kind, 1 as part, place from p where place <= 5 and status != 'archived' union all select q, id, kind, 2, place from w where place <= 5 and status in ('', 'active'))
    select q, id, kind, cast(place as bigint) as place from (select q, id, kind, row_number() over (partition by q order by part, place) as place from u) where place <= 5"""


@query(with_tables("points", "wpages") + f""", {_ASKED_SQL}, now_ as (select id, agent_id, case when ord % 4 = 1 then 'no longer' else name end as name, case when ord % 4 = 1 then 'the same' else summary end as summary, lang, source, importance, status from points where ord % 4 != 2),
    """ + _keyword_sql("now_"))  # fmt: skip
def indexed_keywords(fx: Fixtures) -> DataFrame:
    """Keyword search through the postings of a store whose points were upserted and deleted after they were first written."""
    e = _engine(fx)
    p = fx.points()
    e.store.commit(lambda tx: (tx.write("interest_points", p), tx.write("wiki_pages", fx.pages())))
    e.store.upsert("interest_points", p.filter("ord % 4 = 1").withColumns({"name": F.lit("no longer"), "summary": F.lit("the same")}))
    e.store.delete("interest_points", p.filter("ord % 4 = 2").select("agent_id", "id"))
    found = Y.search(e.store.snapshot(), _asked(fx), 5)
    return found.select("q", "id", "kind", F.col("place").cast("long").alias("place"))


@query(with_tables("points", "wpages") + f", {_ASKED_SQL}, " + _keyword_sql("points"))
def keywords_without_vectors(fx: Fixtures) -> DataFrame:
    """Retrieval of an engine that finds no vectors in its store: queries with vectors are answered by keywords."""
    e = _engine(fx)
    e.store.commit(lambda tx: (tx.write("interest_points", fx.points()), tx.write("wiki_pages", fx.pages())))
    found = e.retrieve(_asked(fx).withColumn("v", F.array(F.lit(1.0), F.lit(0.0))), 5)
    return found.select("q", "id", "kind", F.col("place").cast("long").alias("place"))


@query(with_tables("vecs") + """, s as (select q.id as q, v.id, v.kind, greatest(0.0, list_cosine_similarity(q.v, v.v)) as score from vecs q join vecs v on q.agent_id = v.agent_id where q.ord % 100 = 0)
    select q, id, round(score, 5) as score from (select *, row_number() over (partition by q order by score desc, kind, id) as rank from s) where rank <= 6""")  # fmt: skip
def nearest_in_cells(fx: Fixtures) -> DataFrame:
    """The nearest stored vectors of an agent, through cells that were built over half of them and took in the others when these were written."""
    e = _engine(fx)
    v = fx.vectors().select("id", "agent_id", "kind", "v", "ord")
    e.save_vectors(v.filter("ord % 2 = 0 or ord % 3 = 0"))
    e.reindex_vectors(v.select("agent_id"))
    e.save_vectors(v.filter("not (ord % 2 = 0 or ord % 3 = 0)"))
    near = I.nearest(e.store.snapshot(), v.filter("ord % 100 = 0").select("id", "agent_id", "ord", "v"), 6, least=1)
    return near.select("q", "id", F.round("score", 5).alias("score"))


def _transcripts(fx: Fixtures, agents: int) -> DataFrame:
    return fx.logs().select(
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("session_id"),
        F.concat(F.lit("a"), (F.col("agent_id") % agents).cast("string")).alias("agent_id"),
        F.col("created_at").cast("timestamp").alias("received_at"),
    )


@query(with_tables("logs") + """, t as (select 't' || cast(id as varchar) as s, 'a' || (agent_id % 12) as a, created_at as got from logs), n as (select *, row_number() over (partition by a order by got, s) as n from t)
    select s as session_id, a as agent_id, case when a in ('a3', 'a5') then 'failed' else 'done' end as status, case a when 'a3' then 'ValueError: a3' when 'a5' then 'no vector' else '' end as error, a not in ('a3', 'a5') as processed from n where n = 1""")  # fmt: skip
def isolated_jobs(fx: Fixtures) -> DataFrame:
    """One session of each agent, processed together: an agent whose work raises, and one that is known to fail, leave nothing behind, and all others are committed."""
    e, write = _engine(fx), scratch(fx.spark)
    e.store.write("session_transcripts", _transcripts(fx, 12))
    sessions = write(oldest_unprocessed(e.store.read("session_transcripts")), "sessions")

    def process(rows: DataFrame, still: Callable[[], bool]) -> None:
        def change(tx) -> None:
            tx.mark_processed(rows, _at("2024-06-01"))
            unknown = rows.filter("agent_id = 'a5'").select("agent_id", F.lit("no vector").alias("error"))
            if unknown.limit(1).count():
                raise Failures(unknown)
            if rows.filter("agent_id = 'a3'").limit(1).count():
                raise ValueError("a3")

        e.store.commit(change, still=still)

    jobs = run_isolated(sessions, process, 600, write)
    marked = e.store.read("session_transcripts").select("agent_id", "session_id", F.col("processed_at").isNotNull().alias("processed"))
    return jobs.join(marked, ["agent_id", "session_id"]).select("session_id", "agent_id", "status", "error", "processed")


@query(with_tables("points", "logs") + """ select 'interest_points' as what, count(*) as n from points union all select 'edges', count(*) from logs union all select 'rest', 0""")
def committed_together(fx: Fixtures) -> DataFrame:
    """Two tables that are written in one commit. Another commit, which stops after it has deleted all of both, changes neither and leaves no folder."""
    e = _engine(fx)
    edges = fx.logs().select(F.concat(F.lit("a"), (F.col("agent_id") % 3).cast("string")).alias("agent_id"), F.col("id").cast("string").alias("source_id"), F.lit("t").alias("target_id"), F.lit("related").alias("kind"))
    e.store.commit(lambda tx: (tx.write("interest_points", fx.points()), tx.write("edges", edges)))
    folders = lambda: sum(n.startswith("v-") for t in ("interest_points", "edges") for n in e.store._stat(t))
    before = folders()

    def stops(tx) -> None:
        tx.write("interest_points", tx.read("interest_points").filter("false"))
        tx.write("edges", tx.read("edges").filter("false"))
        raise KeyError("here")

    try:
        e.store.commit(stops)
    except KeyError:
        rest = folders() - before
    count = lambda t: e.store.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n")
    return count("interest_points").unionByName(count("edges")).unionByName(fx.spark.range(1).select(F.lit("rest").alias("what"), F.lit(rest).cast("long").alias("n")))


@query("""with d as (select doc_id, 'a' || (doc_id % 5) as a, cast(doc_id as varchar) as l, cast(doc_id + 1 as varchar) as r from documents)
    select substr(sha256(a || l), 1, 12) as id, l as left_id, r as right_id, case when doc_id % 2 = 0 then 'resolved' else 'open' end as status, case when doc_id % 3 = 0 then '2024-02-01' else '2024-01-01' end as created from d""")  # fmt: skip
def contradiction_writes(fx: Fixtures) -> DataFrame:
    """Contradictions written twice: the second time replaces all but when they were first written."""
    e, i = _engine(fx), F.col("doc_id")
    agent = F.concat(F.lit("a"), (i % 5).cast("string"))
    d = fx.table("documents").select(
        "doc_id", agent.alias("agent_id"), F.substring(F.sha2(F.concat(agent, i.cast("string")), 256), 1, 12).alias("id"),
        i.cast("string").alias("left_id"), (i + 1).cast("string").alias("right_id"), F.lit("open").alias("status"),
    )
    e.store.upsert("contradictions", d.filter("doc_id % 3 != 0").withColumn("created_at", _at("2024-01-01")))
    second = d.filter("doc_id % 3 = 0 or doc_id % 2 = 0").withColumn("status", F.when(i % 2 == 0, "resolved").otherwise("open"))
    e.store.upsert("contradictions", second.withColumn("created_at", _at("2024-02-01")))
    return e.store.read("contradictions").select("id", "left_id", "right_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("""with o as (select 'a' || (o_custkey % 7) as a, 'o' || o_orderkey as s, 'c' || o_custkey as t, o_orderkey % 3 = 0 as c, o_totalprice as w, o_orderkey as k from orders)
    select a as agent_id, s as source_id, t as target_id, case when c then 'contradicts' else 'related' end as kind, round(case when k % 2 = 0 then w + 1 else w end, 2) as weight, '2024-01-01' as created from o
    union all select a, t, s, 'contradicts', round(case when k % 2 = 0 then w + 1 else w end, 2), '2024-01-01' from o where c""")  # fmt: skip
def edge_writes(fx: Fixtures) -> DataFrame:
    """Edges written twice: contradictions in both directions, the second weight counts, and the first time stays."""
    e, k = _engine(fx), F.col("o_orderkey")
    o = fx.table("orders").select(
        F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")).alias("agent_id"), F.concat(F.lit("o"), k.cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target_id"),
        F.when(k % 3 == 0, "contradicts").otherwise("related").alias("kind"), F.col("o_totalprice").alias("weight"), F.lit(0).alias("seq"), "o_orderkey",
    )
    e.save_edges(o.drop("o_orderkey").withColumn("created_at", _at("2024-01-01")))
    e.save_edges(o.filter(k % 2 == 0).drop("o_orderkey").withColumns({"weight": F.col("weight") + 1, "created_at": _at("2024-02-01")}))
    out = e.store.read("edges")
    return out.select("agent_id", "source_id", "target_id", "kind", F.round("weight", 2).alias("weight"), F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("""with o as (select 's' || event_id as s, 'a' || (user_id % 4) as a, event_id as i from events where event_type != 'click' and event_id % 7 != 0)
    select s as session_id, a as agent_id, case when i % 3 = 0 then 2 else 1 end as turn_count, i % 2 = 0 as processed from o""")  # fmt: skip
def transcripts_pushed(fx: Fixtures) -> DataFrame:
    """Pushed sessions: those of an excluded board or without turns aren't taken, a second push replaces the first, and a processed one stays processed."""
    e, i = _engine(fx), F.col("event_id")
    pushes = lambda n: accept_pushes(fx.table("events").select(
        F.concat(F.lit("s"), i.cast("string")).alias("session_id"), F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("agent_id"), F.lit(n).alias("turn_count"),
        F.when(i % 7 == 0, "").otherwise("[]").alias("raw_turns"), F.col("ts").cast("timestamp").alias("received_at"), F.lit("2024-01-01T00:00:00Z").alias("session_date"),
        F.col("event_type").alias("kanban_board"), F.lit("").alias("kanban_board_name"), "event_id",
    ), ["Click "])
    number = F.substring("session_id", 2, 20).cast("long")
    e.store.upsert("session_transcripts", pushes(1))
    e.store.mark_processed(e.store.read("session_transcripts").filter(number % 2 == 0), _at("2024-06-01"))
    e.store.upsert("session_transcripts", pushes(2).filter(number % 3 == 0))
    return e.store.read("session_transcripts").select("session_id", "agent_id", "turn_count", F.col("processed_at").isNotNull().alias("processed"))


@query(with_tables("sims") + """, r as (select a as s, b as t, 'related' as kind, sim as w, aa as g from sims where aa = ba and sim >= 0.4), c as (select cast(doc_id as varchar) as l, cast(doc_id + 1 as varchar) as r from documents)
    select s as source_id, t as target_id, kind, round(w, 6) as weight, g as agent_id from r union all select l, r, 'contradicts', 1, 'docs' from c union all select r, l, 'contradicts', 1, 'docs' from c""")  # fmt: skip
def persist_edges(fx: Fixtures) -> DataFrame:
    """The edges that Engine.persist stores: contradictions in both directions, and related ones among an agent's new points."""
    e, i, now = _engine(fx, fork=Fork(similarity_relate=0.4)), F.col("doc_id"), _at("2024-06-01")
    new = fx.vectors().select(
        "agent_id", "id", F.lit("create").alias("action"), F.col("id").alias("name"), F.lit("s").alias("summary"), F.lit(0.5).alias("importance"),
        F.array(F.lit("k")).alias("keywords"), F.lit(1).alias("seen_count"), now.alias("event_time"),
    )
    against = fx.table("documents").select(
        F.concat(F.lit("x"), i.cast("string")).alias("id"), F.lit("docs").alias("agent_id"), i.cast("string").alias("left_id"), (i + 1).cast("string").alias("right_id"),
        F.lit("").alias("description"), F.lit("open").alias("status"), now.alias("created_at"),
    )
    e.persist(new, now, contradictions=against, vectors=fx.vectors().select("agent_id", "id", "v"))
    out, swap = e.store.read("edges"), (F.col("kind") == "related") & (F.col("source_id").cast("long") > F.col("target_id").cast("long"))
    ends = F.when(swap, F.struct(F.col("target_id").alias("s"), F.col("source_id").alias("t"))).otherwise(F.struct(F.col("source_id").alias("s"), F.col("target_id").alias("t")))
    return out.select(ends.alias("e"), "kind", F.round("weight", 6).alias("weight"), "agent_id").select(F.col("e.s").alias("source_id"), F.col("e.t").alias("target_id"), "kind", "weight", "agent_id")
