"""Catalogue: vector search, lookups, counts, logs, usage, namespaces, text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import coerce as C
from engram.functions import text as X
from engram.functions import vectors as V
from engram.operators import lookups as L
from engram.operators import vectors as K
from engram.plans import recall as R
from engram.plans.fixtures import Fixtures, with_tables
from engram.plans.registry import query
from engram.sources.store import retain_newest

_TOPK_SQL = with_tables("vecs") + """, s as (select q.id as q, v.id, v.kind, v.ord, greatest(0.0, list_cosine_similarity(q.v, v.v)) as score from vecs q, vecs v where q.ord % 100 = 0),
    k as (select *, row_number() over (partition by q, kind order by score desc, ord) as rk from s),
    r as (select *, row_number() over (partition by q order by score desc, kind, ord) as rank from k where rk <= 8),
    top as (select * from r where rank <= 8)"""


#: The query set of vector searches: every row whose id is divisible by 100, against all rows.
ASKED = "ord % 100 = 0"


def _top(fx: Fixtures, k: int = 8) -> DataFrame:
    v = fx.vectors()
    return K.top_k(v.filter(ASKED).select("id", "ord", "v"), v, k)


@query(_TOPK_SQL + " select q, id, kind, round(score, 6) as score, cast(rank as bigint) as rank from top")
def knn_topk(fx: Fixtures) -> DataFrame:
    return _ranked(_top(fx))


def _ranked(top: DataFrame) -> DataFrame:
    return top.select("q", "id", "kind", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_TOPK_SQL + " select q, id, round(score, 6) as score from top where cast(score as float) >= cast(0.3 as float) and kind != 'wiki_page'")
def knn_min_score_kind(fx: Fixtures) -> DataFrame:
    return _near_points(_top(fx))


def _near_points(top: DataFrame) -> DataFrame:
    return R.filter_hits(top, min_score=0.3, include_wiki=False).select("q", "id", F.round("score", 6).alias("score"))


@query(with_tables("sims") + " select a, b, round(sim, 6) as sim from sims where sim > 0.35")
def similar_pairs_gt(fx: Fixtures) -> DataFrame:
    return K.similar_pairs(fx.vectors(), 0.35, strict=True).select("a", "b", F.round("sim", 6).alias("sim"))


@query(with_tables("sims") + " select a, b, round(sim, 6) as sim from sims where sim >= 0.30")
def similar_pairs_ge(fx: Fixtures) -> DataFrame:
    return K.similar_pairs(fx.vectors(), 0.30).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    with_tables("vecs") + " select a.id, round(sqrt(list_sum(list_transform(a.v, lambda x: x * x))), 6) as norm, round(list_cosine_similarity(a.v, b.v), 6) as to_next, greatest(0.0, 1 - 0.5 * 0.5 / 2) as score from vecs a left join vecs b on b.ord = a.ord + 1",
)
def unit_vectors(fx: Fixtures) -> DataFrame:
    v = fx.vectors()
    following = v.select((F.col("ord") - 1).alias("ord"), F.col("v").alias("w"))
    return v.join(following, "ord", "left").select(
        "id",
        F.round(V.norm(F.col("v")), 6).alias("norm"),
        F.when(F.col("w").isNotNull(), F.round(V.cosine(V.unit(F.col("v")), F.col("w")), 6)).alias("to_next"),
        V.distance_score(F.lit(0.5)).alias("score"),
    )


@query(
    with_tables("points") + " select id, agent_id, round(importance, 4) as importance from points where lower(name || ' ' || summary || ' ' || '[\"' || lang || '\",\"' || source || '\"]') like '%src1%' order by importance desc, id limit 50",
)
def keyword_points(fx: Fixtures) -> DataFrame:
    return L.search_points(fx.points(), "SRC1", 50).select("id", "agent_id", F.round("importance", 4).alias("importance"))


@query(
    with_tables("wpages") + " select id, agent_id, title from wpages where lower(title || ' ' || body_md) like '%the%' order by updated_at desc, id limit 50",
)
def keyword_pages(fx: Fixtures) -> DataFrame:
    return L.search_pages(fx.pages(), "The", 50).select("id", "agent_id", "title")


_FALLBACK_SQL = with_tables("points", "wpages") + """, qs as (select * from (values ('q0', 'src3', 'th'), ('q1', 'src3', 'no such text'), ('q2', 'src7', 'de')) t(q, agent_id, text)),
    p as (select q, id, 'interest_point' as kind, status, row_number() over (partition by q order by importance desc, id) as place from qs join points using (agent_id)
          where lower(name || ' ' || summary || ' ' || '["' || lang || '","' || source || '"]') like '%' || lower(text) || '%'),
    w as (select q, id, 'wiki_page' as kind, status, row_number() over (partition by q order by updated_at desc, id) as place from qs join wpages using (agent_id) where lower(title || ' ' || body_md) like '%' || lower(text) || '%'),
    u as (select q, id, kind, 1 as part, place from p where place <= 8 and status != 'archived' union all select q, id, kind, 2, place from w where place <= 8 and status in ('', 'active')),
    ft as (select q, id, kind, place from (select q, id, kind, row_number() over (partition by q order by part, place) as place from u) where place <= 8)"""


def _queries(fx: Fixtures) -> DataFrame:
    return fx.spark.createDataFrame([("q0", "src3", "th"), ("q1", "src3", "no such text"), ("q2", "src7", "de")], "q string, agent_id string, text string")


@query(_FALLBACK_SQL + " select q, id, kind, 0.5::double as score, cast(place as bigint) as place from ft")
def fulltext_fallback(fx: Fixtures) -> DataFrame:
    return R.full_text_fallback(_queries(fx), fx.points(), fx.pages(), 8).select("q", "id", "kind", "score", F.col("place").cast("long").alias("place"))


@query(_FALLBACK_SQL + """, kn as (select 'q' || q as q, id, kind, score, rank as place from (""" + _TOPK_SQL.replace("with vecs", "with vecs2", 1).replace("from vecs q, vecs v", "from vecs2 q, vecs2 v", 1) + """ select * from top)),
    every as (select q, id, kind, round(score, 6) as score, place, 1 as tier from kn union all select q, id, kind, 0.5, place, 2 from ft)
    select q, id, kind, score, cast(place as bigint) as place, tier from (select *, min(tier) over (partition by q) as first from every) where tier = first""")
def retrieval_cascade(fx: Fixtures) -> DataFrame:
    return _cascade(fx)


def _cascade(fx: Fixtures) -> DataFrame:
    v = fx.vectors()
    near = K.top_k(v.filter(ASKED).select(F.concat(F.lit("q"), "id").alias("id"), "ord", "v"), v, 8)
    near = near.select(
        "q",
        F.when(F.col("q") == "q2", "src7").otherwise("src3").alias("agent_id"),
        "id",
        "kind",
        F.round("score", 6).alias("score"),
        F.col("rank").alias("place"),
    )
    hits = R.cascade(near, R.full_text_fallback(_queries(fx), fx.points(), fx.pages(), 8))
    return hits.select("q", "id", "kind", "score", F.col("place").cast("long").alias("place"), "tier")


@query(
    with_tables("points") + " select id, agent_id, name, status from points where (agent_id = 'src1' and ord % 3 = 0) or (agent_id = 'src2' and ord % 7 = 0)",
)
def point_lookup_batch(fx: Fixtures) -> DataFrame:
    p = fx.points()
    ids = p.filter("(agent_id = 'src1' and ord % 3 = 0) or (agent_id = 'src2' and ord % 7 = 0)").select("agent_id", "id")
    ids = ids.unionByName(fx.spark.createDataFrame([("src1", "none")], "agent_id string, id string"))
    return L.by_ids(p, ids).select("id", "agent_id", "name", "status")


@query(
    "with t as (select source as agent_id, unnest([lang, source, '']) as tag from documents), c as (select agent_id, tag, count(*) as n from t where tag != '' group by all) select agent_id, tag, n, row_number() over (partition by agent_id order by n desc, tag) as place from c",
)
def list_tags(fx: Fixtures) -> DataFrame:
    return L.list_tags(
        fx.points().select("agent_id", F.array_append("keywords", F.lit("")).alias("tags")),
    ).select("agent_id", "tag", "n", F.col("place").cast("long").alias("place"))


_COUNTS_SQL = with_tables("points", "wpages") + """, every as (select agent_id, 1 as p, 0 as w, 0 as l from points union all select agent_id, 0, 1, 0 from wpages union all select agent_id, 0, 0, 1 from points where wiki_worthy is not null)
    select agent_id, cast(sum(p) as bigint) as points, cast(sum(w) as bigint) as pages, cast(sum(l) as bigint) as judged from every group by agent_id"""


@query(_COUNTS_SQL)
def stats_per_agent(fx: Fixtures) -> DataFrame:
    p = fx.points()
    return L.agent_stats({"points": p, "pages": fx.pages(), "judged": p.filter("wiki_worthy is not null")})


@query("select source as agent_id, count(*) as n from documents group by source")
def agent_counts(fx: Fixtures) -> DataFrame:
    return fx.points().groupBy("agent_id").agg(F.count("*").alias("n"))


@query(with_tables("points", "wpages") + " select agent_id from points where agent_id != '' union select agent_id from wpages where agent_id != ''")
def list_agents(fx: Fixtures) -> DataFrame:
    return L.list_agents(fx.points(), fx.pages())


_VISIBLE_SQL = """with own as (select n_name as reader, n_name as ns, 0 as ord from nation), other as (select a.n_name as reader, b.n_name as ns, b.n_nationkey + 1 as ord from nation a join nation b using (n_regionkey)),
    f as (select reader, ns, min(ord) as ord from (select * from own union all select * from other) where ns != '' group by all),
    vis as (select reader, ns, row_number() over (partition by reader order by ord, ns) - 1 as ord from f)"""


def _visible(fx: Fixtures) -> DataFrame:
    n = fx.table("nation")
    other = n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(
        F.col("a.n_name").alias("reader"),
        F.col("b.n_name").alias("ns"),
        (F.col("b.n_nationkey") + 1).alias("ord"),
    )
    return R.visible_namespaces(n.select(F.col("n_name").alias("reader")), other)


@query(_VISIBLE_SQL + " select reader, ns, cast(ord as bigint) as ord from vis")
def namespace_visible(fx: Fixtures) -> DataFrame:
    return _visible(fx).select("reader", "ns", F.col("ord").cast("long").alias("ord"))


@query("""with n as (select n_nationkey as k from nation), h as (select k as ns_ord, 'src' || k as agent_id, cast(doc_id % 40 as varchar) as id, 'q' || (doc_id % 3) as q, (doc_id * 31 % 1009) / 1009.0::double as score, doc_id as place from documents, n where source = 'src' || k),
    o as (select *, row_number() over (partition by q, agent_id, id order by ns_ord, place) as n1 from h), r as (select *, row_number() over (partition by q order by score desc, ns_ord, place, agent_id, id) as rank from o where n1 = 1)
    select q, agent_id, id, round(score, 6) as score, rank from r where rank <= 10""")
def cross_ns_dedupe(fx: Fixtures) -> DataFrame:
    return _best_of_namespaces(fx)


def _best_of_namespaces(fx: Fixtures) -> DataFrame:
    n = fx.table("nation").select(F.col("n_nationkey").alias("ns_ord"), F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    i = F.col("doc_id")
    h = fx.table("documents").join(F.broadcast(n), "source").select(
        "ns_ord",
        F.col("source").alias("agent_id"),
        (i % 40).cast("string").alias("id"),
        F.concat(F.lit("q"), (i % 3).cast("string")).alias("q"),
        (i * 31 % 1009 / 1009.0).alias("score"),
        i.alias("place"),
    )
    return R.rerank(h, 10).select("q", "agent_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    with_tables("points") + " select id, strftime(event_time, '%Y-%m-%d %H:%M:%S') as at from points where event_time between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'",
)
def event_time_window(fx: Fixtures) -> DataFrame:
    p = fx.points()
    hits = R.event_times(p.select("agent_id", "id", F.lit("interest_point").alias("kind"), F.lit(0.9).alias("score")), p, fx.pages().limit(0))
    kept = R.filter_hits(hits, after=F.lit("2024-01-05").cast("timestamp"), before=F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return kept.select("id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    with_tables("logs") + " select id, strftime(created_at, '%Y-%m-%d') as day from logs where created_at >= greatest(timestamp '2024-01-10', timestamp '2024-01-25' - interval 7 days)",
)
def recent_days(fx: Fixtures) -> DataFrame:
    hits = fx.logs().select("id", F.col("created_at").cast("timestamp").alias("event_time"), F.lit("interest_point").alias("kind"), F.lit(1.0).alias("score"))
    kept = R.filter_hits(hits, min_score=0, after=F.lit("2024-01-10").cast("timestamp"), now=F.lit("2024-01-25").cast("timestamp"), days=7)
    return kept.select("id", F.date_format("event_time", "yyyy-MM-dd").alias("day"))


@query(with_tables("logs") + " select id, agent_id, action from logs order by created_at desc, id desc limit 50 offset 20")
def log_page(fx: Fixtures) -> DataFrame:
    return L.log_page(fx.logs(), 50, 20).select("id", "agent_id", "action")


@query(with_tables("logs") + """, r as (select *, row_number() over (partition by agent_id order by created_at desc, id desc) as rn, case when agent_id % 10 = 0 then 3 when agent_id % 10 = 1 then 0 else 10 end as cap from logs)
    select id, agent_id from r where cap <= 0 or rn <= cap""")
def log_retention(fx: Fixtures) -> DataFrame:
    logs = fx.logs()
    caps = logs.select("agent_id").distinct().filter("agent_id % 10 < 2").withColumn("cap", F.when(F.col("agent_id") % 10 == 0, 3).otherwise(0))
    return retain_newest(logs, 10, caps).select("id", "agent_id")


@query(
    "select strftime(ts, '%Y-%m-%d') as date, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as input_tokens, count(*) as output_tokens, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as cache_hit_tokens from events group by 1",
)
def usage_daily(fx: Fixtures) -> DataFrame:
    sums = {
        "input_tokens": F.get_json_object("props", "$.k").cast("long"),
        "output_tokens": F.lit(1),
        "cache_hit_tokens": F.when(F.col("event_type") == "click", 1).otherwise(0),
    }
    return L.usage_by_day(fx.table("events"), "ts", sums)


@query("select strftime(ts, '%Y-%m-%d') as date, count(*) as output_tokens from events where strftime(ts, '%Y-%m-%d') >= '2024-01-15' group by 1")
def usage_since(fx: Fixtures) -> DataFrame:
    return L.usage_by_day(fx.table("events"), "ts", {"output_tokens": F.lit(1)}).filter("date >= '2024-01-15'")


@query("select distinct agent_id from (" + with_tables("logs") + " select agent_id from logs)")
def log_agents(fx: Fixtures) -> DataFrame:
    return fx.logs().select("agent_id").distinct()


@query("select c_custkey, c_mktsegment from customer where lower(trim(c_mktsegment)) not in ('building', 'machinery')")
def kanban_exclusion(fx: Fixtures) -> DataFrame:
    return L.exclude_boards(fx.table("customer"), "c_mktsegment", "c_mktsegment", ["building ", " MACHINERY", ""]).select("c_custkey", "c_mktsegment")


@query(
    "select doc_id, substr(sha256(source || '|' || text), 1, 16) as id, substr(sha256(source || '|' || cast(doc_id as varchar) || '|' || text), 1, 16) as claim_id from documents",
)
def hash_ids(fx: Fixtures) -> DataFrame:
    return fx.table("documents").select("doc_id", X.hash_id("source", "text").alias("id"), X.hash_id("source", "doc_id", "text").alias("claim_id"))


@query(
    "select doc_id, sha256(lower(trim(regexp_replace(text, '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')))) as topic from documents",
)
def normalize_topic(fx: Fixtures) -> DataFrame:
    return fx.table("documents").select("doc_id", F.sha2(X.normalize_topic("text"), 256).alias("topic"))


@query("select p_partkey, translate(lower(trim(p_name)), ' _', '--') as id from part")
def normalize_id(fx: Fixtures) -> DataFrame:
    return fx.table("part").select("p_partkey", X.normalize_id("p_name").alias("id"))


@query("""with b as (select doc_id, text, octet_length(encode(text)) as n, [length(text[1:k]) for k in range(0, 62) if strlen(text[1:k]) <= 61] as ks from documents)
    select doc_id, case when n <= 61 then text else text[1:list_max(ks)] || '...' end as cut from b""")
def truncate_utf8(fx: Fixtures) -> DataFrame:
    return fx.table("documents").select("doc_id", X.truncate_utf8("text", 61).alias("cut"))


@query(
    """select o_orderkey, case when lower(o_orderpriority) in ('1-urgent', '2-high') then lower(o_orderpriority) else '2-high' end as priority, case when o_orderstatus in ('O', 'F') then o_orderstatus else 'O' end as status from orders""",
)
def enum_coercion(fx: Fixtures) -> DataFrame:
    return fx.table("orders").select(
        "o_orderkey",
        C.enum(F.lower("o_orderpriority"), ["1-urgent", "2-high"], "2-high").alias("priority"),
        C.enum("o_orderstatus", ["O", "F"], "O").alias("status"),
    )


@query(
    "select l_orderkey, l_linenumber, case when l_discount * 20 > 0 and l_discount * 20 <= 1 then l_discount * 20 else 0.5 end as clamped, case when l_tax * 20 > 0 and l_tax * 20 <= 1 then l_tax * 20 else 0 end as given from lineitem",
)
def confidence_clamp(fx: Fixtures) -> DataFrame:
    return fx.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        C.clamp_confidence(F.col("l_discount") * 20).alias("clamped"),
        C.given_confidence(F.col("l_tax") * 20).alias("given"),
    )


@query(with_tables("jobs") + """, r as (select *, row_number() over (order by done_at, id) as rn from jobs where status in ('done', 'failed')), t as (select count(*) - 5000 as excess from jobs)
    select id, status from jobs where id not in (select id from r, t where rn <= excess)""")
def job_eviction(fx: Fixtures) -> DataFrame:
    return L.evict_jobs(fx.jobs(), 5000).select("id", "status")


@query(
    with_tables("jobs") + ", r as (select *, row_number() over (partition by agent_id order by done_at, id) as rn from jobs where status = 'queued') select agent_id, id from r where rn = 1",
)
def unprocessed_oldest(fx: Fixtures) -> DataFrame:
    return fx.jobs().filter("status = 'queued'").groupBy("agent_id").agg(F.min_by("id", F.struct("done_at", "id")).alias("id"))


@query(
    with_tables("logs") + """, r as (select agent_id, id, row_number() over (partition by agent_id order by created_at desc, id desc) as place from logs) select agent_id, cast(id as varchar) as session_id, place from r where place <= 10""",
)
def session_state_top10(fx: Fixtures) -> DataFrame:
    states = fx.logs().select("agent_id", F.col("id").alias("session_id"), F.col("created_at").alias("pushed_at"))
    return L.newest_sessions(states, 10).select("agent_id", F.col("session_id").cast("string").alias("session_id"), F.col("place").cast("long").alias("place"))


@query(
    with_tables("points") + " select id, '- [' || id || '] ' || case when name = '' then id else name end || ' [interest_point]' || coalesce(' (at ' || strftime(event_time, '%Y-%m-%d') || ')', '') || case when confidence > 0 then ' (confidence ' || printf('%.2f', confidence) || ', ' || reliability_status || ')' else '' end || case when freshness_level not in ('', 'unknown') then ' freshness=' || freshness_level else '' end || chr(10) as line from points",
)
def recall_lines(fx: Fixtures) -> DataFrame:
    blank = F.lit("")
    line = X.render_line(
        F.col("id"),
        F.col("name"),
        F.lit("interest_point"),
        F.col("event_time"),
        F.col("confidence"),
        F.col("reliability_status"),
        F.col("freshness_level"),
        blank,
        blank,
    )
    return fx.points().select("id", line.alias("line"))


@query(_TOPK_SQL + """, best as (select l_orderkey, max_by(l_tax * 10, (l_tax, -l_linenumber)) as c from lineitem group by 1),
    g as (select q, t.id, t.kind, rank, case when t.kind = 'interest_point' then cast(t.id as integer) % 7 / 10.0::double else coalesce(c, 0) end as confidence, 'a' || (cast(t.id as integer) % 2) as agent_id from top t left join best on l_orderkey = cast(t.id as integer)),
    f as (select *, min(rank) over (partition by q, agent_id) as first from g)
    select q, id, kind, agent_id, round(confidence, 6) as confidence, row_number() over (partition by q order by first, rank) as place from f""")
def graded_hits(fx: Fixtures) -> DataFrame:
    return _graded(fx, _top(fx))


def _graded(fx: Fixtures, top: DataFrame) -> DataFrame:
    v = fx.vectors()
    hits = top.withColumn("agent_id", F.concat(F.lit("a"), (F.col("id").cast("int") % 2).cast("string")))
    n = v.select("agent_id", "id", "kind")
    points = n.filter("kind = 'interest_point'").select(
        "agent_id",
        "id",
        F.lit("").alias("name"),
        (F.col("id").cast("int") % 7 / 10.0).alias("confidence"),
        F.lit("unknown").alias("reliability_status"),
        F.lit("unknown").alias("freshness_level"),
    )
    pages = n.filter("kind = 'wiki_page'").select("agent_id", "id", F.lit("").alias("title"))
    claims = fx.table("lineitem").select(
        F.concat(F.lit("a"), (F.col("l_orderkey") % 2).cast("string")).alias("agent_id"),
        F.col("l_orderkey").cast("string").alias("page_id"),
        F.col("l_linenumber").alias("id"),
        (F.col("l_tax") * 10).alias("confidence"),
        F.lit("supported").alias("status"),
        F.lit("fresh").alias("freshness_level"),
    )
    graded = R.regroup_by_agent(R.grade(hits, points, pages, claims))
    return graded.select("q", "id", "kind", "agent_id", F.round("confidence", 6).alias("confidence"), F.col("place").cast("long").alias("place"))
