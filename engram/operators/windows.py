"""Windows over the turns of a session (session_id, idx, role, content), all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_windows(turns: DataFrame, session: list[str], size: int = 10) -> DataFrame:
    """turns with win_no, from 0: size turns each; a size of 0 or less is 10."""
    rn = F.row_number().over(Window.partitionBy(*session).orderBy("idx"))
    return turns.withColumn("win_no", F.floor((rn - 1) / (size if size > 0 else 10)).cast("int"))


def _users(session: list[str]) -> tuple[Column, Column]:
    is_user = F.when(F.col("role") == "user", 1).otherwise(0)
    return is_user, F.sum(is_user).over(Window.partitionBy(*session).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def prefix_windows(turns: DataFrame, session: list[str], step: int = 5, max_windows: int = 8) -> DataFrame:
    """Growing prefixes that end at each step-th user turn, and the whole session if that is another one; with fewer than step
    user turns, just the whole. Of these the last max_windows: session, win_no (from 0), end_idx, n_turns."""
    is_user, cu = _users(session)
    whole = Window.partitionBy(*session)
    marked = turns.withColumn("_u", is_user).withColumn("_cu", cu).withColumn("_last", F.max("idx").over(whole)).withColumn(
        "n_turns",
        F.row_number().over(whole.orderBy("idx")),
    )
    ends = marked.filter(((F.col("_u") == 1) & (F.col("_cu") % step == 0)) | (F.col("idx") == F.col("_last")))
    rank = F.row_number().over(whole.orderBy(F.col("idx").desc()))
    kept = ends.withColumn("_r", rank).filter(F.col("_r") <= max_windows)
    return kept.select(*session, (F.row_number().over(whole.orderBy("idx")) - 1).alias("win_no"), F.col("idx").alias("end_idx"), "n_turns")


def disjoint_windows(turns: DataFrame, session: list[str], step: int = 5, max_windows: int = 8) -> DataFrame:
    """turns with win_no: a window closes with each step-th user turn. The last max_windows windows of a session are kept; numbers are
    those of the whole session."""
    is_user, cu = _users(session)
    numbered = turns.withColumn("win_no", F.floor((cu - is_user) / step).cast("int"))
    top = F.max("win_no").over(Window.partitionBy(*session))
    return numbered.withColumn("_top", top).filter(F.col("win_no") > F.col("_top") - max_windows).drop("_top")


def rendered_turns(turns: DataFrame, session: list[str], with_tools: bool = False) -> DataFrame:
    """Turns that are shown to a model, with their number from 1: users, assistants (and tools), not blank."""
    roles = ["user", "assistant", *(["tool"] if with_tools else [])]
    shown = turns.filter(F.col("role").isin(roles) & (F.trim("content") != ""))
    return shown.withColumn("number", F.row_number().over(Window.partitionBy(*session).orderBy("idx")))


def map_turn_range(start: Column, end: Column, indices: Column) -> Column:
    """A range of shown numbers as a range of turn indices (indices: array, by number): (0, 0) and ranges that start behind the last
    number stay; else both are held between 1 and the last, the end not before the start."""
    n = F.size(indices)
    s = F.greatest(start, F.lit(1))
    e = F.least(F.greatest(end, s), n)
    stay = ((start == 0) & (end == 0)) | (s > n) | (n <= 0)
    at = lambda i: F.get(indices, i - 1).cast("int")
    return F.when(stay, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.struct(at(s).alias("start"), at(F.greatest(e, s)).alias("end")))


def batches(df: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """df with batch_no: consecutive runs of size rows in order."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("batch_no", F.floor((rn - 1) / size).cast("int"))
