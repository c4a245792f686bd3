"""URL filters: longest-match rules, and path-template trees that learn from the pages the rules decide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm._spark import Workspace


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains, if the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

#: Path segments that the SQL of the query goes down; the tree goes down to the deepest path.
DEPTH = 3


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (host first, then path; of equally long ones, block), as struct<rule, verdict>; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r.verdict != "block", r.name))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def path_segments(path: Column) -> Column:
    """The segments; a segment of digits, or of hex digits with a digit, is variable from the start."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    number = lambda s: s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$")
    code = lambda s: s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]")
    return F.transform(parts, lambda s: F.when(number(s), F.regexp_replace(s, "^[0-9]+", "*")).when(code(s), F.lit("*")).otherwise(s))


@dataclass(frozen=True)
class Growth:
    """How a tree grows: z of the test, pseudo-labels at the parent's purity, and the purity above the root."""

    z: float = 1.96
    pull: float = 5.0
    prior: float = 1.0

    def smoothed(self, good: Column, bad: Column, up: Column) -> Column:
        return (good + F.lit(self.pull) * up) / (good + bad + F.lit(self.pull))

    def differs(self, good: Column, bad: Column, all_good: Column, all_bad: Column) -> Column:
        """If a child's labelled share differs from that of its node's other children (two proportions); without labels it doesn't."""
        n, m = F.nullif(good + bad, F.lit(0)), F.nullif(all_good + all_bad, F.lit(0))
        other, share = F.nullif(m - n, F.lit(0)), all_good / m
        se = F.sqrt(share * (1 - share) * (1 / n + 1 / other))
        told = (n > 0) & (other > 0) & (share > 0) & (share < 1)
        return F.when(told, F.abs(good / n - (all_good - good) / other) > self.z * se).otherwise(F.lit(False))


def grow_tree(shapes: DataFrame, growth: Growth, write: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """shapes: host, _s (path segments), good, bad, and _gt, _gp: the template (segments) and purities, root first, of the shape in
    a wider tree, or null. Returns host, _s, _t (template segments), _p (purities, root first) for each shape.

    At each depth the children of a node whose labels don't differ from its others' merge into its wildcard, but for those that the wider
    tree names; the others stay, however many there are. So a template lies in one template of the wider tree. Its purity is its labelled share, smoothed
    towards the mean of its parent's purity and that of the wider template (without one: its parent's). The tree goes
    down to the deepest path; a round only carries the shapes that go on.
    """
    wider = lambda depth, up: F.coalesce((up + F.get("_gp", F.lit(depth))) / 2, up)
    top = shapes.groupBy("host").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"), F.first(F.get("_gp", F.lit(0))).alias("_root"))
    root = growth.smoothed(F.col("_g"), F.col("_b"), F.coalesce("_root", F.lit(growth.prior)))
    top = top.select("host", "_g", "_b", F.array(root).alias("_p"))
    open_ = write(shapes.join(top, "host").withColumn("_t", F.array().cast("array<string>")), f"{name}0")
    deepest = shapes.agg(F.max(F.size("_s"))).first()[0] or 0
    done = open_.filter(F.size("_s") == 0)
    for depth in range(deepest):
        open_ = open_.filter(F.size("_s") > depth).withColumn("_c", F.get("_s", F.lit(depth)))
        named = F.coalesce(F.first(F.get("_gt", F.lit(depth))) != "*", F.lit(False)).alias("named")
        children = open_.groupBy("host", "_t", "_c").agg(
            F.sum("good").alias("cg"),
            F.sum("bad").alias("cb"),
            F.first("_g").alias("_g"),
            F.first("_b").alias("_b"),
            named,
        )
        apart = F.col("named") | growth.differs(F.col("cg"), F.col("cb"), F.col("_g"), F.col("_b"))
        moves = children.select("host", "_t", "_c", F.when(apart, F.col("_c")).otherwise("*").alias("_next"))
        moved = write(open_.join(moves, ["host", "_t", "_c"]).drop("_c", "_g", "_b"), f"{name}_moved{depth + 1}")
        nodes = moved.groupBy("host", "_t", "_next").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
        open_ = moved.join(nodes, ["host", "_t", "_next"])
        own = growth.smoothed(F.col("_g"), F.col("_b"), wider(depth + 1, F.get("_p", F.lit(depth))))
        extended = [F.concat("_t", F.array("_next")).alias("_t"), F.concat("_p", F.array(own)).alias("_p")]
        open_ = write(open_.select("host", "_s", "good", "bad", "_gt", "_gp", "_g", "_b", *extended), f"{name}{depth + 1}")
        done = done.unionByName(open_.filter(F.size("_s") == depth + 1))
    return done.select("host", "_s", "_t", "_p")


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, growth: Growth | None = None, least_purity: float = 0.25) -> DataFrame:
    """pages (page_id, url; more columns are ignored): page_id, host, path, rule, verdict, template, purity.

    Rules decide what they fit, and label it; no other labels of urls exist. For the rest path-template trees decide: one over
    the paths of all hosts, then one per host (see grow_tree), whose purities are smoothed towards the first one's. So a
    template that was blocked wherever it was labelled is blocked on hosts without labels, and a host's own labels
    prevail as they get many. A template under least_purity is blocked.
    Null urls and urls without :// have empty host and path, and are judged by the tree of the empty host. Repeated rows
    are judged alike, ties don't arise (counts decide), and an empty table gives no rows. Very long paths cost a round per segment. A host or a
    path shape of any number of rows is pre-aggregated first.
    """
    rules, growth = RULES if rules is None else rules, growth or Growth()
    base = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    base = base.withColumn("_m", match_rule(F.col("host"), F.col("path"), rules)).withColumn("_s", path_segments(F.col("path")))
    labelled = [F.sum(F.when(F.col("_m.verdict") == v, 1).otherwise(0)).alias(name) for v, name in (("allow", "good"), ("block", "bad"))]
    work = Workspace(pages.sparkSession, "url_filter")
    shapes = work.write(base.groupBy("host", "_s").agg(*labelled), "shapes")

    blank = [F.lit(None).cast("array<string>").alias("_gt"), F.lit(None).cast("array<double>").alias("_gp")]
    every = shapes.groupBy("_s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    wide = grow_tree(every.select(F.lit("").alias("host"), "_s", "good", "bad", *blank), growth, work.write, "all")
    wide = work.write(wide.select("_s", F.col("_t").alias("_gt"), F.col("_p").alias("_gp")), "wide")
    own = grow_tree(shapes.join(wide, "_s"), growth, work.write, "host")
    template = F.concat(F.lit(""), F.array_join(F.transform("_t", lambda t: F.concat(F.lit("/"), t)), ""))
    verdicts = own.select("host", "_s", template.alias("template"), F.element_at("_p", -1).alias("purity"))
    judged = base.join(work.write(verdicts, "verdicts"), ["host", "_s"])
    work.keep_only("verdicts")
    verdict = F.coalesce("_m.verdict", F.when(F.col("purity") < least_purity, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
