"""Order-dependent folds of candidates, restated as aggregates with an explicit order (ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import normalize_topic


def filter_candidates(candidates: DataFrame, window: list[str], least: float = 0.3, most: int = 20) -> DataFrame:
    """Candidates of at least that confidence, the first `most` of each window by ord."""
    rank = F.row_number().over(Window.partitionBy(*window).orderBy("ord"))
    return candidates.filter(F.col("confidence") >= least).withColumn("_rn", rank).filter(F.col("_rn") <= most).drop("_rn")


def fold_candidates(candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Candidates (ord, topic, reason, confidence, subjective, tags, start, end, worthy) of one normalised topic as one row.

    Topic, reason, subjective and confidence are those of the most confident (the earliest of equals); start is the smallest above 0, else
    0; end the largest; tags are the first row's, then those of the others that aren't there yet; worthy is the first that isn't null;
    ord is the first one's. Candidates with a blank topic stay alone.
    """
    scope = scope or []
    key = normalize_topic("topic")
    keyed = candidates.withColumn("_key", F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit("\u0000"), F.col("ord").cast("string"))).otherwise(key))
    best = F.max_by(F.struct("topic", "reason", "subjective", "confidence"), F.struct(F.col("confidence"), -F.col("ord")))
    grouped = keyed.groupBy(*scope, "_key").agg(
        best.alias("_b"),
        F.min("ord").alias("ord"),
        F.coalesce(F.min(F.when(F.col("start") > 0, F.col("start"))), F.lit(0)).alias("start"),
        F.max("end").alias("end"),
        F.sort_array(F.collect_list(F.struct("ord", "tags"))).alias("_tags"),
        F.min_by("worthy", F.when(F.col("worthy").isNotNull(), F.col("ord"))).alias("worthy"),
        F.count("*").alias("n_merged"),
    )
    more = F.flatten(F.transform(F.slice("_tags", 2, F.size("_tags")), lambda t: t.tags))
    first = F.get("_tags", F.lit(0)).tags
    tags = F.concat(first, F.array_except(F.array_distinct(more), first))
    return grouped.select(*scope, "ord", "_b.topic", "_b.reason", "_b.subjective", "_b.confidence", "start", "end", tags.alias("tags"), "worthy", "n_merged")


def best_claim(claims: DataFrame) -> DataFrame:
    """The most confident claim of each page (ties: smallest id): agent_id, page_id, confidence, status, freshness_level."""
    w = Window.partitionBy("agent_id", "page_id").orderBy(F.col("confidence").desc(), F.col("id"))
    return claims.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("agent_id", "page_id", "confidence", "status", "freshness_level")


def dialog_span(members: DataFrame, unit: list[str]) -> DataFrame:
    """Smallest start, largest end and earliest event time of a unit's members."""
    return members.groupBy(*unit).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("event_time").alias("event_time"))
