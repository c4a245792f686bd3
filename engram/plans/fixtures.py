"""Domain tables as deterministic expressions over the driver's tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fixtures:
    """The domain tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def turns(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("session_id"),
            F.concat(F.lit("agent-"), (F.col("conv_id") % 4).cast("string")).alias("agent_id"),
            F.col("turn").alias("idx"),
            "role",
            F.col("text").alias("content"),
        )

    def transcripts(self) -> DataFrame:
        t = self.turns().groupBy("session_id", "agent_id").agg(F.sort_array(F.collect_list(F.struct("idx", "role", "content"))).alias("ts"))
        return t.select(
            "session_id",
            "agent_id",
            F.size("ts").alias("turn_count"),
            F.to_json(F.transform("ts", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))).alias("raw_turns"),
        )

    def points(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels").select("doc_id", "quality")
        i = F.col("doc_id")
        return d.join(lab, "doc_id", "left").select(
            i.cast("string").alias("id"), F.col("source").alias("agent_id"), F.substring("text", 1, 40).alias("name"), F.col("text").alias("summary"), F.array("lang", "source").alias("keywords"),
            (i * 37 % 101 / 100.0).alias("importance"), F.when(i % 17 == 0, "archived").otherwise("active").alias("status"), (i % 5 == 0).alias("subjective"),
            F.when(i % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + i * 3600)).alias("event_time"), (i * 13 % 97 / 97.0).alias("confidence"),
            F.element_at(F.array(F.lit("supported"), F.lit("contested"), F.lit("unknown")), (i % 3 + 1).cast("int")).alias("reliability_status"),
            F.element_at(F.array(F.lit("fresh"), F.lit("aging"), F.lit("stale"), F.lit("unknown")), (i % 4 + 1).cast("int")).alias("freshness_level"),
            F.lit(1).alias("seen_count"), (F.col("quality") == 1).alias("wiki_worthy"), i.alias("ord"),
        )

    def candidates(self) -> DataFrame:
        i = F.col("doc_id")
        return self.table("documents").select(
            i.alias("ord"), F.col("text").alias("topic"), F.col("source").alias("reason"), (i * 13 % 97 / 97.0).alias("confidence"), (i % 5 == 0).alias("subjective"), F.array(
                F.col("lang"),
                F.col("source"),
                F.concat(F.lit("k"), (i % 3).cast("string")),
            ).alias("tags"),
            (i % 7).cast("int").alias("start"), (i % 7 + i % 3).cast("int").alias("end"), F.when(i % 4 != 0, i % 2 == 0).alias("worthy"), (i % 50).alias("win"),
        )

    def pages(self) -> DataFrame:
        i = F.col("page_id")
        lang, host = F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1), F.regexp_extract("url", r"://[^/]*\.([a-z]+)/", 1)
        return self.table("pages").select(
            F.concat(F.lit("page-"), i.cast("string")).alias("id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("agent_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("body_md"),
            F.element_at(
                F.array(F.lit("active"), F.lit(""), F.lit("superseded"), F.lit("archived")),
                F.when(i % 10 < 7, 1).when(i % 10 == 7, 2).when(i % 10 == 8, 3).otherwise(4),
            ).alias("status"),
            F.element_at(F.array(F.lit("entity"), F.lit("concept"), F.lit("synthesis"), F.lit("source")), (i % 4 + 1).cast("int")).alias("page_type"),
            F.array(lang, host).alias("tags"), F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("updated_at"), F.when(
                i % 3 != 0,
                F.timestamp_seconds(F.lit(1704067200) + i * 7200),
            ).alias("event_time"), i.alias("ord"),
        )

    def linked_pages(self) -> DataFrame:
        """Pages whose body is made of wiki links of their hrefs; a path of one segment, lower-case, is a page id there."""
        targets = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
        body = F.array_join(F.transform(targets, lambda t: F.concat(F.lit("see [["), t, F.lit("]]"))), "\n")
        i = F.col("page_id")
        known = F.element_at(F.array(F.lit("the"), F.lit("and"), F.lit("ing")), (i % 3 + 1).cast("int"))
        return self.table("pages").select(
            F.when(i < 3, known).otherwise(F.concat(F.lit("page-"), i.cast("string"))).alias("id"),
            F.lit("a").alias("agent_id"),
            body.alias("body_md"),
        )

    def vectors(self) -> DataFrame:
        i = F.col("vec_id")
        return self.table("embeddings").select(
            i.cast("string").alias("id"),
            i.alias("ord"),
            F.concat(F.lit("a"), (i % 2).cast("string")).alias("agent_id"),
            F.when(F.col("label") % 2 == 0, "interest_point").otherwise("wiki_page").alias("kind"),
            F.col("embedding").alias("v"),
            "label",
        )

    def logs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("agent_id"),
            F.col("ts").alias("created_at"),
            F.col("event_type").alias("action"),
            F.col("props").alias("title"),
        )

    def jobs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("agent_id"),
            status.alias("status"),
            F.col("o_orderdate").alias("done_at"),
            F.col("o_totalprice").alias("price"),
        )


#: The same tables as SQL, by name; a query names those it needs.
SQL = {
    "turns": "select conv_id as session_id, 'agent-' || (conv_id % 4) as agent_id, turn as idx, role, text as content from conversations",
    "points": """select cast(d.doc_id as varchar) as id, source as agent_id, substr(text, 1, 40) as name, text as summary, lang, source,
        (d.doc_id * 37 % 101) / 100.0::double as importance, case when d.doc_id % 17 = 0 then 'archived' else 'active' end as status, d.doc_id % 5 = 0 as subjective,
        case when d.doc_id % 11 != 0 then timestamp '2024-01-01' + to_hours(cast(d.doc_id as integer)) end as event_time, (d.doc_id * 13 % 97) / 97.0::double as confidence,
        ['supported', 'contested', 'unknown'][d.doc_id % 3 + 1] as reliability_status, ['fresh', 'aging', 'stale', 'unknown'][d.doc_id % 4 + 1] as freshness_level,
        1 as seen_count, quality = 1 as wiki_worthy, d.doc_id as ord from documents d left join labels l on d.doc_id = l.doc_id""",
    "candidates": """select doc_id as ord, text as topic, source as reason, (doc_id * 13 % 97) / 97.0::double as confidence, doc_id % 5 = 0 as subjective, [lang, source, 'k' || (doc_id % 3)] as tags,
        cast(doc_id % 7 as integer) as start, cast(doc_id % 7 + doc_id % 3 as integer) as "end", case when doc_id % 4 != 0 then doc_id % 2 = 0 end as worthy, doc_id % 50 as win from documents""",
    "wpages": """select 'page-' || page_id as id, 'src' || (page_id % 20) as agent_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, html as body_md,
        case when page_id % 10 < 7 then 'active' when page_id % 10 = 7 then '' when page_id % 10 = 8 then 'superseded' else 'archived' end as status,
        ['entity', 'concept', 'synthesis', 'source'][page_id % 4 + 1] as page_type, [regexp_extract(url, '://[^/]*/([a-z]+)/', 1), regexp_extract(url, '://[^/]*\\.([a-z]+)/', 1)] as tags,
        timestamp '2024-01-01' + to_minutes(cast(page_id as integer)) as updated_at, case when page_id % 3 != 0 then timestamp '2024-01-01' + to_hours(cast(page_id * 2 as integer)) end as event_time, page_id as ord from pages""",
    "linked": """select case when page_id < 3 then ['the', 'and', 'ing'][page_id % 3 + 1] else 'page-' || page_id end as id, 'a' as agent_id,
        regexp_extract_all(html, 'href="/([^"]*)"', 1) as targets from pages""",
    "vecs": "select cast(vec_id as varchar) as id, vec_id as ord, 'a' || (vec_id % 2) as agent_id, case when label % 2 = 0 then 'interest_point' else 'wiki_page' end as kind, cast(embedding as double[]) as v, label from embeddings",
    "sims": "select a.id as a, b.id as b, a.ord as ao, b.ord as bo, a.agent_id as aa, b.agent_id as ba, list_cosine_similarity(a.v, b.v) as sim from vecs a, vecs b where a.ord < b.ord",
    "logs": "select event_id as id, user_id as agent_id, ts as created_at, event_type as action, props as title from events",
    "jobs": "select o_orderkey as id, o_custkey as agent_id, case o_orderstatus when 'O' then 'queued' when 'F' then 'done' else 'failed' end as status, o_orderdate as done_at, o_totalprice as price from orders",
}

_NEEDS = {"sims": ["vecs"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """WITH ... of some of these tables, in order; a statement may go on with further ones behind a comma."""
    seen: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in seen:
                seen.append(x)
    return f"with {'recursive ' if recursive else ''}" + ", ".join(f"{n} as ({SQL[n]})" for n in seen)
