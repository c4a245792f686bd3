"""Catalogue: persisted points, mixed vectors, results and references of entries, keys and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.config import Config
from engram.engine import Engine
from engram.functions import coerce as C
from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import results as R
from engram.operators import vectors as K
from engram.operators import view as W
from engram.plans.fixtures import Fixtures, with_tables
from engram.plans.registry import query
from engram.schemas import conform
from engram.sources.scratch import scratch, scratch_path


def _now():
    return F.lit("2024-06-01").cast("timestamp")


@query(with_tables("points") + """, c as (select id, agent_id, ord % 3 as k, name as old_name, importance as i0, confidence as c0, reliability_status as r0, freshness_level as f0, subjective as s0 from points)
    select id, case when k = 0 then 'update' else 'archive' end as action, case when k = 0 then 'active' else 'archived' end as status, case when k = 0 then 'u' || id else old_name end as name,
      round(case when k = 0 then 0.9::double else i0 end, 6) as importance, round(c0, 6) as confidence, r0 as reliability_status, f0 as freshness_level, s0 as subjective, case when k = 0 then 7 else 1 end as seen_count from c where k < 2
    union all select 'new-' || id, 'create', 'active', 'n' || id, 0.4, 0.4, 'unknown', 'unknown', false, 1 from c where k = 2""")
def persist_update(fx: Fixtures) -> DataFrame:
    """What Engine.persist stores: updates and archivings start from the stored points; created ones are unknown in reliability and freshness."""
    p = fx.points()
    k, i = F.col("ord") % 3, F.col("id")
    change = p.select(
        "agent_id", F.when(k == 2, F.concat(F.lit("new-"), i)).otherwise(i).alias("id"), F.when(k == 0, "update").when(k == 1, "archive").otherwise("create").alias("action"),
        F.concat(F.when(k == 2, "n").otherwise("u"), i).alias("name"), F.lit("s").alias("summary"), F.when(k == 2, 0.4).otherwise(0.9).alias("importance"), F.array(F.lit("k")).alias("keywords"),
        F.when(k == 2, 1).otherwise(7).alias("seen_count"), "event_time",
    )
    e = _stored(fx)
    out = e.persist(change, _now())
    return e.store.read("interest_points").join(out.select("agent_id", "id", "action"), ["agent_id", "id"]).select(
        "id",
        "action",
        "status",
        "name",
        F.round("importance", 6).alias("importance"),
        F.round("confidence", 6).alias("confidence"),
        "reliability_status",
        "freshness_level",
        "subjective",
        "seen_count",
    )


@query(with_tables("vecs") + """, m as (select id, ord, case when ord % 3 = 0 then v[1:32] else v end as v from vecs)
    select a.id as a, b.id as b, round(case when len(a.v) = len(b.v) then list_cosine_similarity(a.v, b.v) end, 6) as sim from m a, m b where a.ord < b.ord and case when len(a.v) = len(b.v) then list_cosine_similarity(a.v, b.v) >= 0.45 else false end""")
def similar_pairs_mixed(fx: Fixtures) -> DataFrame:
    """Vectors of two dimensions in one table: each is compared with its like."""
    v = fx.vectors().withColumn("v", F.when(F.col("ord") % 3 == 0, F.slice("v", 1, 32)).otherwise(F.col("v")))
    return K.similar_pairs(v, 0.45).select("a", "b", F.round("sim", 6).alias("sim"))


@query(with_tables("vecs") + """, m as (select id, ord, kind, case when ord % 3 = 0 then v[1:32] else v end as v from vecs),
    s as (select q.id as q, m.id, m.kind, m.ord, case when len(q.v) = len(m.v) then greatest(0.0, list_cosine_similarity(q.v, m.v)) end as score from m q, m where q.ord % 100 = 0),
    k as (select *, row_number() over (partition by q, kind order by score desc, ord) as rk from s where score is not null), r as (select *, row_number() over (partition by q order by score desc, kind, ord) as rank from k where rk <= 5)
    select q, id, round(score, 6) as score, rank from r where rank <= 5""")
def knn_mixed(fx: Fixtures) -> DataFrame:
    """A search over vectors of two dimensions finds those of the query's own."""
    v = fx.vectors().withColumn("v", F.when(F.col("ord") % 3 == 0, F.slice("v", 1, 32)).otherwise(F.col("v")))
    near = K.top_k(v.filter("ord % 100 = 0").select("id", "ord", "v"), v, 5)
    return near.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    with_tables("vecs") + " select id, round(3 * v[1] / sqrt(list_sum(list_transform(v, lambda x: 9 * x * x))), 6) as first, len(v) as n, 1.0::double as norm from vecs",
)
def stored_vectors(fx: Fixtures) -> DataFrame:
    """Vectors are stored with length one."""
    u = fx.vectors().withColumn("v", V.unit(F.transform("v", lambda x: x * 3)))
    return u.select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.size("v").cast("long").alias("n"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query(with_tables("points") + """, c as (select l_orderkey as k, count(*) as n, min(l_linenumber || '-' || l_partkey) as first from lineitem group by 1)
    select id, 'interest_point' as kind, name as title, md5(summary) as body, status, round(confidence, 6) as confidence, freshness_level as freshness, 0::bigint as n_claims, null as first_claim from points
    union all select 'o' || o_orderkey, 'wiki_page', o_orderpriority, md5(o_orderstatus), 'active', null, 'unknown', coalesce(n, 0), first from orders left join c on k = o_orderkey""")
def result_projection(fx: Fixtures) -> DataFrame:
    """Points and pages as clients see them."""
    points = conform(fx.points(), "interest_points")
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    pages = fx.table("orders").select(
        F.lit("a").alias("agent_id"),
        key("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("body_md"),
        F.lit("active").alias("status"),
    )
    claims = fx.table("lineitem").select(
        F.lit("a").alias("agent_id"),
        key("l_orderkey").alias("page_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("id"),
        F.lit("t").alias("text"),
        F.lit("s").alias("status"),
        F.lit(0.5).alias("confidence"),
    )
    out = R.entry_results(points, pages, claims)
    return out.select(
        "id",
        "kind",
        "title",
        F.md5("body").alias("body"),
        "status",
        F.round("confidence", 6).alias("confidence"),
        "freshness",
        F.size("claims").cast("long").alias("n_claims"),
        F.get("claims", F.lit(0)).id.alias("first_claim"),
    )


@query("""with recursive st as (select doc_id as k, doc_id % 7 < 4 as archived, doc_id % 7 != 6 and doc_id + 1 <= (select max(doc_id) from documents) as nxt from documents),
    r(k, pos) as (select k, k + 1 from st where nxt union all select r.k, r.pos + 1 from r join st on st.k = r.pos where st.archived and st.nxt)
    select cast(r.k as varchar) as id, case when page_id % 10 < 8 then 'wiki_page' else 'interest_point' end as kind, case when page_id % 10 < 8 then 'page-' || pos else cast(pos as varchar) end as to_id from r join st on st.k = r.pos left join pages on page_id = pos where not st.archived""")
def replacement_refs(fx: Fixtures) -> DataFrame:
    """What replaces archived points: the successor's page where it has an active one."""
    d, i = fx.table("documents").select("doc_id"), F.col("doc_id")
    a = F.lit("a").alias("agent_id")
    sequel = d.filter("doc_id % 7 != 6").select(
        a,
        i.cast("string").alias("source_id"),
        (i + 1).cast("string").alias("target_id"),
        F.lit("sequel").alias("kind"),
        F.lit(1.0).alias("weight"),
    )
    page = d.select(
        a,
        i.cast("string").alias("source_id"),
        F.concat(F.lit("page-"), i.cast("string")).alias("target_id"),
        F.lit("has_page").alias("kind"),
        F.lit(1.0).alias("weight"),
    )
    p = d.select(a, i.cast("string").alias("id"), F.lit("n").alias("name"), F.when(i % 7 < 4, "archived").otherwise("active").alias("status"))
    out = R.replacement_refs(p, sequel.unionByName(page), p, fx.pages().withColumn("agent_id", F.lit("a")))
    return out.select("id", "replacement.kind", F.col("replacement.id").alias("to_id"))


@query(
    with_tables("wpages") + ", p as (select id, agent_id, title, status, md5(body_md) as body, tags from wpages) select id, agent_id, title, status, body, array_to_string(tags, ',') as tags from p",
)
def review_page_projection(fx: Fixtures) -> DataFrame:
    out = R.review_pages(fx.pages().withColumn("sources", F.array().cast("array<string>")))
    return out.select("id", "agent_id", "title", "status", F.md5("body").alias("body"), F.array_join("tags", ",").alias("tags"))


@query("select o_orderkey as id, o_custkey as agent_id from orders where o_orderkey % 3 != 0")
def job_namespace(fx: Fixtures) -> DataFrame:
    """Requests for jobs of another agent find nothing."""
    jobs = fx.jobs()
    asked = jobs.select("id", F.when(F.col("id") % 3 == 0, F.col("agent_id") + 1).otherwise(F.col("agent_id")).alias("agent_id"))
    return R.own_jobs(asked, jobs).select("id", "agent_id")


@query("""select event_id, 'u' || user_id || chr(0) || event_type || chr(0) || 'topk=8;wiki=' || case when event_id % 2 = 0 then 'true' else 'false' end || ';minscore=0.3000;' || case when event_id % 3 = 0 then 'after=' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ';' else '' end || 'days=' || (event_id % 5) as recall_key,
    'm' || chr(0) || '64' || chr(0) || sha256(props) as embed_key from events""")
def cache_keys(fx: Fixtures) -> DataFrame:
    e, i = fx.table("events"), F.col("event_id")
    after = F.when(i % 3 == 0, F.col("ts")).cast("timestamp")
    key = R.recall_key(
        F.concat(F.lit("u"), F.col("user_id").cast("string")),
        F.col("event_type"),
        F.lit(8),
        i % 2 == 0,
        F.lit(0.3),
        after,
        F.lit(None).cast("timestamp"),
        i % 5,
    )
    return e.select("event_id", key.alias("recall_key"), R.embed_key(F.lit("m"), F.lit(64), F.col("props")).alias("embed_key"))


@query("""with l as (select user_id, event_type, max_by(value, (ts, cast(cast(floor(value) as bigint) as varchar))) as f from events group by 1, 2)
    select cast(user_id as varchar) as agent_id, '{' || string_agg('"' || event_type || '":"' || cast(cast(floor(f) as bigint) as varchar) || '"', ',' order by event_type) || '}' as state from l group by 1""")
def push_state(fx: Fixtures) -> DataFrame:
    """The newest fingerprint of each session, as one JSON object per agent, and read back from it."""
    e = fx.table("events").select(
        F.col("user_id").cast("string").alias("agent_id"),
        F.col("event_type").alias("session_id"),
        F.floor("value").cast("string").alias("fingerprint"),
        F.col("ts").alias("received_at"),
    )
    states = R.push_state(e)
    return R.push_state(R.read_state(states).withColumn("received_at", F.lit(0)))


@query("""select doc_id, cast(doc_id as varchar) as fenced, case when doc_id % 3 = 0 then lang else lang || chr(10) || source end as candidate, lang || ' ' || source || ' ' || lang as entry,
    '<memory_context>' || chr(10) || lang || chr(10) || '</memory_context>' as wrapped, case when doc_id % 2 = 0 then source || ' -> ' || lang else source end as archived from documents""")
def text_forms(fx: Fixtures) -> DataFrame:
    """Answers without their fence, texts of candidates and entries that are embedded, wrapped memory, log texts of archived entries."""
    d, i = fx.table("documents"), F.col("doc_id")
    n = i.cast("string")
    fenced = F.when(i % 3 == 0, F.concat(F.lit(" ```json\n"), n, F.lit("\n```\n"))).when(i % 3 == 1, F.concat(F.lit("```\n"), n, F.lit("```"))).otherwise(n)
    return d.select(
        "doc_id", X.strip_fence(fenced).alias("fenced"), X.candidate_text(
            "lang",
            F.when(i % 3 == 0, "").otherwise(F.col("source")),
        ).alias("candidate"), X.entry_body("lang", F.array("source", "lang")).alias("entry"),
        X.wrap_memory("lang").alias("wrapped"), X.describe_archived(F.col("source"), F.when(i % 2 == 0, F.col("lang")).otherwise("")).alias("archived"),
    )


@query("""select event_id, case when event_id % 2 = 0 then event_type || '|x' else '' end as strings, case when event_id % 3 = 0 then 'a-b:related' else '' end as edges,
    case when event_id % 4 = 0 then 'contested:0.5' when event_id % 4 = 1 then 'supported:0.25' else '' end as claims, case when event_id % 5 = 0 then null else strftime(ts, '%Y-%m-%d %H:%M:%S') end as at, strftime(case when event_id % 5 = 0 then timestamp '2024-01-01' else date_trunc('second', ts) end, '%Y-%m-%d %H:%M:%S') as event_at from events""")
def decoded_arguments(fx: Fixtures) -> DataFrame:
    """Lists, edges, claims and dates as tools get them, well-formed or not."""
    e, i = fx.table("events"), F.col("event_id")
    kind = F.col("event_type")
    strings = F.when(i % 2 == 0, F.concat(F.lit('[" '), kind, F.lit(' ", "", "x"]'))).otherwise("no list")
    edges = F.when(i % 3 == 0, '[{"target_id": " A_B ", "kind": "Related"}, {"target_id": "", "kind": "x"}, {"target_id": "y"}]').otherwise("{")
    claims = F.when(
        i % 4 == 0,
        '```json\n[{"text": "t", "status": "contested", "confidence": 7}, {"text": " "}]\n```',
    ).when(i % 4 == 1, '[{"text": "t", "status": "odd", "confidence": 0.25}]').otherwise("7")
    date = F.when(i % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    pair = lambda a, b: F.concat(a, F.lit(":"), b.cast("string"))
    at = C.rfc3339(date)
    return e.select(
        "event_id", F.array_join(C.json_list(strings), "|").alias("strings"), F.array_join(
            F.transform(C.edge_list(edges), lambda x: pair(x.target_id, x.kind)),
            "|",
        ).alias("edges"),
        F.array_join(
            F.transform(C.claim_list(claims), lambda x: pair(x.status, x.confidence)),
            "|",
        ).alias("claims"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.date_format(C.event_time(at, F.lit("2024-01-01").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("event_at"),
    )


@query(
    with_tables("vecs") + ", q as (select id, v from vecs where ord % 100 = 0) select q.id as q, vecs.label as label, round(max(list_cosine_similarity(q.v, vecs.v)), 6) as affinity from q, vecs group by 1, 2",
)
def member_affinity(fx: Fixtures) -> DataFrame:
    """The largest cosine between a vector and the members of each group."""
    v = fx.vectors()
    return K.group_affinity(v.filter("ord % 100 = 0"), v, "label").select("q", "label", F.round("affinity", 6).alias("affinity"))


@query(
    with_tables("wpages") + " select id, case when title = '' or ord % 4 = 0 then id else title end as title, '{\"agent_id\":\"' || agent_id || '\",\"ord\":' || ord || '}' as body from wpages",
)
def hit_bodies(fx: Fixtures) -> DataFrame:
    """Titles of hits (an id stands in for a missing one), and rows as JSON."""
    p = fx.pages().withColumn("title", F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("title")))
    return W.as_json(W.hit_titles(p.select("id", "title", "agent_id", "ord")), ["id", "title"])


def _stored(fx: Fixtures) -> Engine:
    """An engine over a fresh store with points, pages, edges and transcripts."""
    e = Engine(fx.spark, Config(root=scratch_path(fx.spark, "catalog_store")))
    e.store.write("interest_points", fx.points())
    e.store.write("wiki_pages", fx.pages())
    i = F.col("event_id")
    e.store.write(
        "edges",
        fx.table("events").select(
            F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("agent_id"),
            i.cast("string").alias("source_id"),
            (i + 1).cast("string").alias("target_id"),
            F.lit("related").alias("kind"),
            F.col("value").alias("weight"),
        ),
    )
    return e


@query(with_tables("points", "wpages") + """, p as (select 'point' as what, id, row_number() over (order by importance desc, id) as place from points where agent_id = 'src1'), w as (select 'page' as what, id, null::bigint as place from wpages where agent_id = 'src3' and page_type = 'source'),
    e as (select 'edge' as what, cast(event_id as varchar) as id, row_number() over (order by value desc, cast(event_id as varchar)) as place from events where user_id % 3 = 1)
    select * from p union all select * from w union all select * from e""")
def engine_lists(fx: Fixtures) -> DataFrame:
    """An agent's points by importance, pages of a type, and edges by weight, out of the store."""
    e = _stored(fx)
    place = lambda df, *order: df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    points = place(e.interest_points("src1").select(F.lit("point").alias("what"), "id", "importance"), F.col("importance").desc(), "id").drop("importance")
    pages = e.wiki_pages("src3", "source").select(F.lit("page").alias("what"), "id", F.lit(None).cast("long").alias("place"))
    edges = place(e.edges("a1").select(F.lit("edge").alias("what"), F.col("source_id").alias("id"), "weight"), F.col("weight").desc(), "id").drop("weight")
    return points.unionByName(pages).unionByName(edges)


@query(with_tables("points") + """, o as (select id, agent_id, name, ord, ord % 4 as k from points) select id, agent_id, case when k = 1 then 'changed' else name end as name, case when k = 1 then '2024-01-01' else '2023-01-01' end as last_seen, '2023-01-01' as first_seen from o where k != 2
    union all select 'x' || id, agent_id, 'added', '2024-01-01', '2024-01-01' from o where k = 3""")
def store_writes(fx: Fixtures) -> DataFrame:
    """A store after upserts, which keep when a point was first seen, and deletes."""
    e, k, i = _stored(fx), F.col("ord") % 4, F.col("id")
    at = lambda t: F.lit(t).cast("timestamp")
    p = fx.points()
    e.store.write("interest_points", p.withColumns({"first_seen_at": at("2023-01-01"), "last_seen_at": at("2023-01-01")}))
    new = p.filter("ord % 4 in (1, 3)").withColumns(
        {
            "id": F.when(k == 3, F.concat(F.lit("x"), i)).otherwise(i),
            "name": F.when(k == 3, "added").otherwise("changed"),
            "first_seen_at": at("2024-01-01"),
            "last_seen_at": at("2024-01-01"),
        },
    )
    e.store.upsert("interest_points", new)
    e.store.delete("interest_points", p.filter("ord % 4 = 2").select("agent_id", "id"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return e.store.read("interest_points").select("id", "agent_id", "name", day("last_seen_at").alias("last_seen"), day("first_seen_at").alias("first_seen"))


@query(
    with_tables("logs") + """, t as (select 't' || cast(id as varchar) as s, 'a' || (agent_id % 5) as a, created_at as got, id from logs), p as (select *, row_number() over (partition by a order by got, s) as n from t) select s as session_id, a as agent_id, n <= 3 as processed from p""",
)
def processed_in_order(fx: Fixtures) -> DataFrame:
    """Three rounds of processing: each takes the session of every agent that was received first."""
    from engram.plans.process import oldest_unprocessed

    e = _stored(fx)
    t = fx.logs().select(
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("session_id"),
        F.concat(F.lit("a"), (F.col("agent_id") % 5).cast("string")).alias("agent_id"),
        F.col("created_at").cast("timestamp").alias("received_at"),
    )
    e.store.write("session_transcripts", t)
    for _ in range(3):
        e.store.mark_processed(scratch(fx.spark)(oldest_unprocessed(e.store.read("session_transcripts")), "oldest"), _now())
    return e.store.read("session_transcripts").select("session_id", "agent_id", F.col("processed_at").isNotNull().alias("processed"))
