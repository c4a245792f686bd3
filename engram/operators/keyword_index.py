"""A keyword index kept by every write: postings of the trigrams of what keyword search looks at. Candidates are confirmed by the search's own LIKE, so that hits are the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.phrases import first_with
from engram.plans import recall as R
from engram.sources.postings import COMPLETE, lists, page_bodies, point_bodies, trigrams
from engram.sources.scratch import scratch
from engram.sources.store import Snapshot

#: Of a text's trigrams, the rarest that choose its candidates.
RAREST = 4
#: Trigrams of all texts up to which they are named in the scan's filter.
NAMED = 10_000
#: Postings of all texts up to which they are brought together by text. Of more, which grow with texts times entries, those of each different rarest trigram are taken once.
BY_TEXT = 1_000_000
#: Share of the entries from which on candidates aren't picked out: nearly all are read anyway, and picking them would exchange their bodies.
MOST = 0.5


def text_grams(texts: DataFrame) -> DataFrame:
    """texts (agent_id, text): agent_id, text, gram; of the parts between wildcards and escapes, which have to stand in a body as they are."""
    parts = F.split(F.lower("text"), r"[%_\\\\]")
    return texts.select("agent_id", "text", F.explode(F.array_distinct(F.flatten(F.transform(parts, trigrams)))).alias("gram"))


def listed(lists: DataFrame) -> DataFrame:
    """lists (agent_id, kind, ids): agent_id, kind, id, each once of the lists that come to a task together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whose = batch.column("ids"), pc.list_parent_indices(batch.column("ids"))
            rows = pa.table([batch.column("agent_id").take(whose), batch.column("kind").take(whose), ids.flatten()], ["agent_id", "kind", "id"])
            yield from rows.group_by(rows.column_names).aggregate([]).to_batches()

    return lists.select("agent_id", "kind", "ids").mapInArrow(run, "agent_id string, kind string, id string")


def candidates(grams: DataFrame, index: DataFrame) -> DataFrame | None:
    """grams (agent_id, text, gram), of a table that is written: agent_id, kind, id of the entries that hold the rarest trigrams of one of the texts. None if there are no grams."""
    write = scratch(grams.sparkSession)
    named = [r[0] for r in grams.select("gram").distinct().limit(NAMED + 1).collect()]
    if not named:
        return None
    if len(named) <= NAMED:
        index = index.filter(F.col("gram").isin(named))
    index = lists(index)
    asked = grams.select("agent_id", "gram").distinct()
    counts = index.join(asked, ["agent_id", "gram"], "left_semi").groupBy("agent_id", "gram").agg(F.sum(F.size("ids")).alias("n"))
    ranked = grams.join(counts, ["agent_id", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.row_number().over(Window.partitionBy("agent_id", "text").orderBy("n", "gram"))
    chosen = write(ranked.withColumn("_r", rarest).filter(F.col("_r") <= RAREST), "chosen")
    if chosen.agg(F.sum("n")).first()[0] > BY_TEXT:
        first = chosen.filter("_r = 1").select("agent_id", "gram").distinct()
        return listed(index.join(first, ["agent_id", "gram"], "left_semi")).distinct()
    needed = chosen.groupBy("agent_id", "text").agg(F.count("*").alias("needed"))
    met = index.join(chosen, ["agent_id", "gram"]).select("agent_id", "text", "kind", F.explode("ids").alias("id")).groupBy("agent_id", "text", "kind", "id").agg(F.count("*").alias("met"))
    return met.join(needed, ["agent_id", "text"]).filter("met = needed").select("agent_id", "kind", "id").distinct()


def search(at: Snapshot, queries: DataFrame, k: int) -> DataFrame:
    """What R.full_text_fallback finds for queries (q, agent_id, text) in the stored points and pages, of which only the candidates of the index are read through LIKE, once for all queries; queries of less than
    three characters between wildcards have no trigrams and go through all entries of their agents, as all queries do in a store without postings. Only
    the parts of the store that the agents lie in are read."""
    write = scratch(queries.sparkSession)
    asked = write(queries.select("q", "agent_id", F.lower("text").alias("text")).filter("agent_id is not null and text != ''"), "asked")
    parts = at.store.parts_of(asked)
    texts = write(asked.select("agent_id", "text").distinct(), "texts")
    grams = write(text_grams(texts), "grams")
    short = texts
    if at.rules.get(COMPLETE):
        short = texts.join(grams.select("agent_id", "text").distinct(), ["agent_id", "text"], "left_anti")
    whole = write(short.select("agent_id").distinct(), "whole")
    some = not whole.isEmpty()
    found = candidates(grams, at.read("point_postings", parts).unionByName(at.read("page_postings", parts)))
    found = None if found is None else write(found, "candidates")

    def hits(entries: DataFrame, kind: str, by: Column, passes: Column) -> DataFrame:
        chosen = entries.join(whole, "agent_id", "left_semi")
        mine = None if found is None else found.filter(F.col("kind") == kind)
        if mine is not None and mine.count() >= MOST * entries.count():
            chosen = entries
        elif mine is not None:
            rest = entries.join(whole, "agent_id", "left_anti") if some else entries
            rest = rest.join(mine, ["agent_id", "id"], "left_semi")
            chosen = chosen.unionByName(rest) if some else rest
        first = first_with(texts, chosen.withColumns({"body": F.lower("body"), "by": by}), k)
        rank = F.row_number().over(Window.partitionBy("agent_id", "text").orderBy(F.col("by").desc(), "id"))
        first = first.withColumn("place", rank).filter(F.col("place") <= k).withColumn("kind", F.lit(kind))
        return R.cut_hits(first.join(asked, ["agent_id", "text"]), k, [F.col("by").desc(), F.col("id")], passes)

    points = hits(point_bodies(at.read("interest_points", parts)), "interest_point", F.col("importance"), R.point_passes())
    pages = hits(page_bodies(at.read("wiki_pages", parts)), "wiki_page", F.unix_micros("updated_at"), R.page_passes())
    return R.points_then_pages(points, pages, k)
