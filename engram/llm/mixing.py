"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm._spark import Workspace, maybe_broadcast, rank_in_groups, ranges_for


def token_count(text: Column) -> Column:
    """Words between spaces (null: none): what a document costs of its leaf's budget."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def epoch_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """An evenly spread long: the first 15 hex digits of an MD5, shifted to the top."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 4)


def split_budget(nodes: DataFrame, parent: list[str], ties: list[str], budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Shares each parent's budget out among its children by weight, none getting more than its cap: what a
    child can't take goes to its siblings, again by weight. All numbers are longs (cap times the sum of weights has
    to fit one); `budget` is the same in all rows of a parent and at most the sum of their caps. Children are looked at in
    order of cap per weight: the first ones are full, and the rest share what is left. What rounding down leaves goes, one
    each, to the first with room.
    """
    order = [F.col(cap).cast("double") / F.col(weight), *ties]
    all_ = Window.partitionBy(*parent)
    up = all_.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = all_.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = nodes.withColumn("_left", F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn(
        "_weights",
        F.sum(weight).over(all_) - F.coalesce(F.sum(weight).over(before), F.lit(0)),
    )
    step = step.withColumn("_short", F.when(F.col(cap) * F.col("_weights") > F.col("_left") * F.col(weight), 1).otherwise(0))
    step = step.withColumn("_n", F.sum("_short").over(up))
    first = (F.col("_n") == 1) & (F.col("_short") == 1)
    step = step.withColumn("_rest", F.max(F.when(first, F.col("_left"))).over(all_)).withColumn("_by", F.max(F.when(first, F.col("_weights"))).over(all_))
    step = step.withColumn("_share", F.when(F.col("_n") == 0, F.col(cap)).otherwise(F.least(F.expr(f"(_rest * {weight}) div _by"), F.col(cap))))
    step = step.withColumn("_odd", F.col(budget) - F.sum("_share").over(all_)).withColumn("_room", F.when(F.col("_share") < F.col(cap), 1).otherwise(0))
    step = step.withColumn("_turn", F.sum("_room").over(up))
    share = F.col("_share") + F.when((F.col("_room") == 1) & (F.col("_turn") <= F.col("_odd")), 1).otherwise(0)
    return step.select(*nodes.columns, share.cast("long").alias(out))


def leaf_targets(leaves: DataFrame, levels: list[str], budget_percent: int, max_epochs: int) -> DataFrame:
    """leaves: one row per leaf with `levels`, supply and weight. Returns levels, supply, target. Budgets go from the
    root down; a node can take the sum of what its leaves can, so a shortage stays among siblings as long as they have room
    and reaches an ancestor's other children only beyond that. A node's weight is the sum of its leaves'.
    """
    tree = leaves.withColumn("_root", F.lit(0))
    all_ = Window.partitionBy("_root")
    tree = tree.withColumn("_total", F.expr(f"(sum(supply) over (partition by _root) * {int(budget_percent)}) div 100"))
    tree = tree.withColumn("_cap", F.col("supply") * max_epochs).filter("_cap > 0 and weight > 0")
    tree = tree.withColumn("_budget", F.least("_total", F.sum("_cap").over(all_))).drop("_total")
    for depth in range(len(levels)):
        parent, own = ["_root", *levels[:depth]], ["_root", *levels[: depth + 1]]
        nodes = tree.groupBy(*own).agg(F.sum("_cap").alias("_node_cap"), F.sum("weight").alias("_node_weight"), F.max("_budget").alias("_parent"))
        shares = split_budget(nodes, parent, own, "_parent", "_node_weight", "_node_cap", "_given")
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in own]
        tree = tree.alias("l").join(shares.alias("r"), on).select(
            *[F.col(f"l.{c}").alias(c) for c in tree.columns if c != "_budget"],
            F.col("r._given").alias("_budget"),
        )
    return tree.select(*levels, "supply", F.col("_budget").alias("target"))


def _mix(docs: DataFrame, levels: dict[str, Column], weight: Column, budget_percent: int, max_epochs: int, seed: int) -> DataFrame:
    """row (all columns of docs), l0, l1, ... (levels), n_tokens, target, copies. See mix_sources."""
    names = list(levels)
    inner = [f"l{i}" for i in range(len(names))]
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        *[levels[c].alias(a) for a, c in zip(inner, names, strict=True)],
        token_count(F.col("text")).alias("tokens"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("tie"),
    )
    named = [F.col(a).alias(b) for a, b in zip(inner, names, strict=True)]
    work = Workspace(docs.sparkSession, "mixing")
    leaves = rows.groupBy(*inner).agg(F.sum("tokens").alias("supply"), F.count("*").alias("size"))
    weighted = leaves.select(*named, F.col("supply").alias("_supply"), F.col("size").alias("_size")).withColumn("_weight", weight.cast("long"))
    leaves = work.write(
        weighted.select(
            *[F.col(b).alias(a) for a, b in zip(inner, names, strict=True)],
            F.col("_supply").alias("supply"),
            F.col("_weight").alias("weight"),
            F.col("_size").alias("size"),
        ),
        "leaves",
    )
    n_leaves, largest = leaves.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    targets = leaf_targets(leaves.drop("size"), inner, budget_percent, max_epochs)
    targets = targets.select(*[F.col(c).alias(f"t_{c}") for c in inner], "supply", "target", F.monotonically_increasing_id().alias("leaf"))
    targets = work.write(targets, "targets")
    on = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in inner]
    placed = rows.join(maybe_broadcast(targets), on, "left").drop(*[f"t_{c}" for c in inner])
    placed = placed.withColumn("epochs", F.coalesce(F.expr("target div supply"), F.lit(0)))
    placed = rank_in_groups(
        placed,
        ["leaf"],
        epoch_order(seed, F.col("epochs"), F.col("id")),
        [F.col("id"), F.col("tie")],
        "before",
        F.col("tokens"),
        ranges_for(largest),
        n_leaves + 1,
    )
    target = F.coalesce("target", F.lit(0)).cast("long")
    rest = target - F.col("epochs") * F.coalesce("supply", F.lit(0))
    copies = F.when(target <= 0, 0).when(F.col("tokens") == 0, 1).otherwise(F.col("epochs") + F.when(F.col("before") < rest, 1).otherwise(0))
    return placed.select("row", *inner, F.col("tokens").alias("n_tokens"), target.alias("target"), copies.cast("int").alias("copies"))


def mix_sources(docs: DataFrame, levels: dict[str, Column], weight: Column, budget_percent: int = 80, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """docs (doc_id, text, ...) with its levels, n_tokens, target (tokens of its leaf) and copies (how often it is taken).

    levels names the tree's levels from the root, each with its expression; weight is a leaf's weight, a long over
    those names. The whole budget is budget_percent of all tokens. A leaf reads its documents in seeded
    epochs, each a fresh permutation, until its target is reached: whole epochs, then the prefix of the next one that
    starts below the target. Rows without tokens (null and empty texts) cost nothing and are taken once if their leaf has a target. Leaves
    of weight 0 or less get nothing (copies 0). Null levels form leaves of their own; which one of equal rows comes first
    doesn't matter. A leaf of any size is read in hash ranges, never by one task. An empty table gives no rows. Columns of docs
    that are named like a level or a result are replaced by it; other names never clash.
    """
    names = list(levels)
    mixed = _mix(docs, levels, weight, budget_percent, max_epochs, seed)
    kept = [c for c in docs.columns if c not in (*names, "n_tokens", "target", "copies")]
    own = [F.col(f"l{i}").alias(c) for i, c in enumerate(names)]
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in kept], *own, "n_tokens", "target", "copies")


def mixed_copies(docs: DataFrame, levels: dict[str, Column], weight: Column, budget_percent: int = 80, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it (see mix_sources)."""
    mixed = _mix(docs, levels, weight, budget_percent, max_epochs, seed)
    taken = mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def take_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix, each as often as it is taken; columns: those of them that are returned."""
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).filter("copies > 0").select(*columns)
