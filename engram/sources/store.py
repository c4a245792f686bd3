"""Keyed tables over versioned Parquet: upserts, deletes, retention."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.schemas import KEPT, SORTED, TABLES, conform, schema
from engram.sources.postings import COMPLETE, INDEXED

T = TypeVar("T")


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """Keyed merge of new (one row per key) into old, same columns. A conflict replaces all columns but those whose policy is
    keep (the old value stays) or add (old + new)."""
    policy = policy or {}
    in_old, in_new = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()
    joined = old.withColumn("_there", F.lit(1)).alias("o").join(
        new.withColumn("_there", F.lit(1)).alias("n"),
        [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key],
        "full_outer",
    )
    out = []
    for c in old.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        both = {"keep": o, "add": F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0))}.get(policy.get(c, ""), n)
        out.append(F.when(in_old & in_new, both).when(in_new, n).otherwise(o).alias(c))
    return joined.select(*out)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def add_edge_pairs(edges: DataFrame, once: bool = False) -> DataFrame:
    """Edges to write: contradicts also in the other direction; of equal keys, the last written (highest seq) counts.
    once: no two edges of a kind are known to have the same two ends, so that there are no equal keys to bring together."""
    back = F.struct(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    there = F.struct("source_id", "target_id")
    both = edges.withColumn("_e", F.explode(F.when(F.col("kind") == "contradicts", F.array(there, back)).otherwise(F.array(there))))
    both = both.withColumn("source_id", F.col("_e.source_id")).withColumn("target_id", F.col("_e.target_id")).drop("_e")
    return both if once else latest_per_key(both, ["agent_id", "source_id", "target_id", "kind"], [F.col("seq")])


#: Widths of the ranges of time, as powers of two of microseconds, by which an agent's rows are counted: 9.5 hours, and about a second in one of those.
WIDE, NARROW = 35, 20


def retain_newest(logs: DataFrame, default_cap: int, caps: DataFrame | None = None) -> DataFrame:
    """The newest rows of each agent, up to its own cap (agent_id, cap) or the default; a cap of 0 or less is none. No task gets all rows of an agent: they are counted by range of
    time, the counts say in which second of an agent the cap falls, newer rows stay and older ones go, and only the rows of one second are ever ranked together."""
    if caps is None and default_cap <= 0:
        return logs
    time = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62)))
    keyed = logs.withColumns({"_wide": F.shiftright(time, WIDE), "_narrow": F.shiftright(time, NARROW), "_time": time})

    def cut(rows: DataFrame, limits: DataFrame | None, by: str) -> DataFrame:
        """Per agent the range in which its limit is reached, and how many rows of that range may stay."""
        counts = rows.groupBy("agent_id", by).agg(F.count("*").alias("_n"))
        newer = F.sum("_n").over(Window.partitionBy("agent_id").orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_newer", F.coalesce(newer, F.lit(0)))
        limit = F.lit(default_cap).cast("long")
        if limits is not None:
            counts, limit = counts.join(limits, "agent_id", "left"), F.coalesce("_limit", limit)
        counts = counts.withColumn("_limit", limit).filter((F.col("_limit") > 0) & (F.col("_newer") < F.col("_limit")) & (F.col("_newer") + F.col("_n") >= F.col("_limit")))
        return counts.select("agent_id", F.col(by).alias("_cut"), (F.col("_limit") - F.col("_newer")).alias("_limit"))

    wide = cut(keyed, None if caps is None else caps.select("agent_id", F.col("cap").cast("long").alias("_limit")), "_wide")
    inside = keyed.join(wide.select("agent_id", F.col("_cut").alias("_wide")), ["agent_id", "_wide"], "left_semi")
    narrow = cut(inside, wide.select("agent_id", "_limit"), "_narrow")
    rank = F.row_number().over(Window.partitionBy("agent_id", "_narrow").orderBy(F.col("_time").desc(), F.col("id").desc()))
    ranked = keyed.withColumn("_rank", rank).join(narrow, "agent_id", "left")
    stays = F.col("_cut").isNull() | (F.col("_narrow") > F.col("_cut")) | ((F.col("_narrow") == F.col("_cut")) & (F.col("_rank") <= F.col("_limit")))
    return ranked.filter(stays).select(*logs.columns)


def write_back_reliability(points: DataFrame, audits: DataFrame, now: Column) -> DataFrame:
    """points after audits (agent_id, id, reliability_status, confidence, freshness_level, evidence): only given fields replace
    ('' and confidences outside (0, 1] aren't given), evidence is appended, archived points stay as they are."""
    a = audits.select(*[F.col(c).alias(f"a_{c}") for c in audits.columns])
    joined = points.join(a, (F.col("agent_id") == F.col("a_agent_id")) & (F.col("id") == F.col("a_id")), "left")
    hit = F.col("a_id").isNotNull() & (F.col("status") != "archived")
    new = {
        "reliability_status": F.when(hit & (F.coalesce("a_reliability_status", F.lit("")) != ""), F.col("a_reliability_status")),
        "confidence": F.when(hit & (F.col("a_confidence") > 0) & (F.col("a_confidence") <= 1), F.col("a_confidence")),
        "freshness_level": F.when(hit & (F.coalesce("a_freshness_level", F.lit("")) != ""), F.col("a_freshness_level")),
        "evidence": F.when(hit, F.concat("evidence", "a_evidence")),
        "updated_at": F.when(hit, now),
    }
    return joined.select(*[(F.coalesce(new[c], F.col(c)) if c in new else F.col(c)).alias(c) for c in points.columns])


class Conflict(RuntimeError):
    """Other writers kept coming first."""


class Refused(ValueError):
    """A rule of the store forbids a write, such as the dimension of its vectors."""


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Puts a whole file in place, unless there is one; False then. Local: a hard link, which is never made over another file. HDFS and its like: a rename without overwriting. Both
    happen at once or not at all, whoever else tries. Object stores promise neither, so they are refused: a Store takes a `publish` of one's own there (a conditional put)."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/_{uuid.uuid4().hex}")
    scheme = fs.getUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs"):
        raise Refused(f"{scheme}: has no rename that is sure not to replace a file; give the store a publish function")
    out = fs.create(aside, False)
    out.write(bytearray(data))
    out.close()
    try:
        if scheme == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark._sc._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(aside))
        else:
            none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, none)
            return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(aside, False)
    return True


#: Table: part: folders. A version also keeps the rules that writes have laid down, such as {"vectors.dimension": 64}.
Manifest = dict[str, dict[str, list[str]]]

#: Folders of a part that was added to, at which it is written anew as one.
MOST_FOLDERS = 16


def _folders(manifest: Manifest) -> set[str]:
    return {f"{t}/{f.split('/')[0]}" for t, parts in manifest.items() for part in parts.values() for f in part}


class Snapshot:
    """All tables as of one version."""

    def __init__(self, store: Store, number: int):
        self.store, self.number = store, number
        self.manifest, self.rules = store._manifest(number)

    def read(self, table: str, parts: set[str] | None = None) -> DataFrame:
        return self.store._load(table, self.manifest.get(table, {}), parts)


class Transaction(Snapshot):
    """Changes of any tables that become visible together. Reads see the changes made before. Nothing is visible, and nothing remains, if it isn't committed."""

    def __init__(self, store: Store, number: int):
        super().__init__(store, number)
        self.base = {t: {p: list(f) for p, f in parts.items()} for t, parts in self.manifest.items()}
        self.seen: dict[str, set[str] | None] = {}  # parts that were read or written; None: all
        self.added: Manifest = {}
        self.demands: dict[str, object] = {}
        self.folders: list[str] = []

    def _touch(self, table: str, parts: set[str] | None) -> None:
        before = self.seen.get(table, set())
        self.seen[table] = None if parts is None or before is None else before | parts

    def read(self, table: str, parts: set[str] | None = None) -> DataFrame:
        self._touch(table, parts)
        return super().read(table, parts)

    def read_for(self, table: str, rows: DataFrame) -> DataFrame:
        """The parts of a table that may hold something of the agents of rows."""
        return self.read(table, self.store.parts_of(rows))

    def _save(self, table: str, df: DataFrame, dealt: bool = False) -> dict[str, list[str]]:
        folder = f"v-{uuid.uuid4().hex[:12]}"
        self.folders.append(f"{table}/{folder}")
        return self.store._save(table, folder, df, dealt)

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows whose keys aren't in the table, or are there with the same content, without reading or writing the rest of their parts: writers that only add never begin again. A part
        of many folders is written anew as one."""
        rows = conform(rows, table)
        for part, folders in self._save(table, rows).items():
            if len(self.manifest.get(table, {}).get(part, [])) >= MOST_FOLDERS:
                self.update(table, lambda old: old.dropDuplicates(TABLES[table][1]), {part})
            self.manifest.setdefault(table, {}).setdefault(part, []).extend(folders)
            if table not in self.seen or (self.seen[table] is not None and part not in self.seen[table]):
                self.added.setdefault(table, {}).setdefault(part, []).extend(folders)

    def write(self, table: str, df: DataFrame, parts: set[str] | None = None, dealt: bool = False) -> None:
        """Replaces the whole table, or the parts that are named. What is derived from them is replaced, too. dealt: rows of a part lie together as they are."""
        self._touch(table, parts)
        new = self._save(table, df, dealt)
        kept = {} if parts is None else {p: f for p, f in self.manifest.get(table, {}).items() if p not in parts}
        self.manifest[table] = kept | new
        if table in INDEXED:
            name, derive = INDEXED[table]
            self.write(name, derive(self.store._load(table, new)), parts, dealt=True)
            self.demand(COMPLETE, 1)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], parts: set[str] | None = None) -> None:
        self.write(table, change(self.read(table, parts)), parts)

    def demand(self, rule: str, value: object) -> None:
        """Lays down a rule for this and all later writers; Refused if another value holds."""
        if self.rules.get(rule, value) != value:
            raise Refused(f"{rule} is {self.rules[rule]}, not {value}")
        self.demands[rule] = value

    def upsert(self, table: str, new: DataFrame) -> None:
        rows = conform(new, table)
        if parts := self.store.parts_of(rows):
            self.update(table, lambda old: upsert(old, rows, TABLES[table][1], KEPT.get(table)), parts)

    def delete(self, table: str, keys: DataFrame, on: list[str] | None = None) -> None:
        on = on or TABLES[table][1]
        parts = self.store.parts_of(keys) if "agent_id" in on else None
        if parts is None or parts:
            self.update(table, lambda old: delete_keys(old, keys, on), parts)

    def append_log(self, rows: DataFrame, retain: int = 0) -> None:
        """Adds change-log rows (upserted by id), then keeps the newest `retain` of each agent."""
        new = conform(rows, "change_log")
        if parts := self.store.parts_of(new):
            self.update("change_log", lambda old: retain_newest(upsert(old, new, TABLES["change_log"][1]), retain), parts)

    def mark_processed(self, sessions: DataFrame, now: Column) -> None:
        done = sessions.select("agent_id", "session_id").distinct().withColumn("_done", F.lit(1))

        def mark(old: DataFrame) -> DataFrame:
            at = F.when(F.col("_done") == 1, now).otherwise(F.col("processed_at"))
            return old.join(done, ["agent_id", "session_id"], "left").withColumn("processed_at", at)

        if parts := self.store.parts_of(done):
            self.update("session_transcripts", mark, parts)

    def rebased(self, manifest: Manifest, rules: dict) -> tuple[Manifest, dict] | None:
        """What to publish after a newer version, if that has left alone all that was read or written here; None otherwise."""
        for rule, value in self.demands.items():
            if rules.get(rule, value) != value:
                return None
        out = {t: {p: list(f) for p, f in parts.items()} for t, parts in manifest.items()}
        for table, parts in self.added.items():
            for part, folders in parts.items():
                out.setdefault(table, {}).setdefault(part, []).extend(folders)
        for table, parts in self.seen.items():
            then, newest, mine = self.base.get(table, {}), manifest.get(table, {}), self.manifest.get(table, {})
            for part in {*then, *newest, *mine} if parts is None else parts:
                if then.get(part) != newest.get(part):
                    return None
                if part in mine:
                    out.setdefault(table, {})[part] = mine[part]
                else:
                    out.get(table, {}).pop(part, None)
        return out, rules | self.demands


class Store:
    """All tables under one root, in versions. A version is one file, named by its number, that says for every table which folders hold each of its parts; parts are hashes
    of agent_id, so that a write only touches the parts of the agents it is about. A transaction makes the folders of all tables it changes and then publishes the next number, which
    only one writer gets: so several tables change together or not at all. A writer that comes second publishes its folders on top of the new version if that left alone the parts
    that it read or wrote, and else begins again; folders that aren't published are removed. Readers of an older version aren't disturbed as long as it is among the last `keep`.
    Folders of writers that died go after `orphan_seconds`. A table that was never written is empty.

    publish(path, data): puts a file in place unless there is one, and says whether it did (see put_if_absent).
    """

    def __init__(
        self, spark: SparkSession, root: str, parts: int = 64, keep: int = 20, attempts: int = 20, orphan_seconds: float = 86_400, publish: Callable[[str, bytes], bool] | None = None
    ):
        self.spark, self.root, self.parts, self.keep, self.attempts, self.orphan_seconds = spark, root.rstrip("/"), parts, keep, attempts, orphan_seconds
        self.publish = publish or (lambda path, data: put_if_absent(spark, path, data))

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _stat(self, path: str) -> dict[str, float]:
        """Names in a folder, with the time of their last change in seconds."""
        p, fs = self._at(path)
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(p)} if fs.exists(p) else {}

    def _drop(self, paths: list[str]) -> None:
        for path in paths:
            p, fs = self._at(path)
            fs.delete(p, True)

    def version(self) -> int:
        """The number of the newest version; 0 if there is none."""
        return max((int(n) for n in self._stat("_versions") if n.isdigit()), default=0)

    def _manifest(self, number: int) -> tuple[Manifest, dict]:
        if not number:
            return {}, {}
        p, fs = self._at(f"_versions/{number:012d}")
        source = fs.open(p)
        try:
            read = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
        finally:
            source.close()
        return read["tables"], read["rules"]

    def _part(self, df: DataFrame) -> Column:
        by = "agent_id" if "agent_id" in df.columns else "key" if "key" in df.columns else None
        return F.pmod(F.xxhash64(by), F.lit(self.parts)).cast("int") if by else F.lit(0)

    def parts_of(self, rows: DataFrame) -> set[str]:
        """The parts of rows: at most `parts` numbers."""
        return {str(r[0]) for r in rows.select(self._part(rows)).distinct().collect()}

    def _load(self, table: str, manifest: dict[str, list[str]], parts: set[str] | None = None) -> DataFrame:
        folders = sorted(f for p, of_part in manifest.items() if parts is None or p in parts for f in of_part)
        if not folders:
            return self.spark.createDataFrame([], schema(table))
        return conform(self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{table}/{f}" for f in folders]), table)

    def _save(self, table: str, folder: str, df: DataFrame, dealt: bool = False) -> dict[str, list[str]]:
        """dealt: df is made row by row of files of this store, each of which is of one part, so that nothing has to be exchanged."""
        rows = conform(df, table)
        rows = rows.withColumn("_part", self._part(rows))
        rows = (rows if dealt else rows.hint("rebalance", F.col("_part"))).sortWithinPartitions("_part", *SORTED.get(table, []))
        rows.write.partitionBy("_part").option("maxRecordsPerFile", 5_000_000).parquet(f"{self.root}/{table}/{folder}")
        return {n.removeprefix("_part="): [f"{folder}/{n}"] for n in self._stat(f"{table}/{folder}") if n.startswith("_part=")}

    def _vacuum(self) -> None:
        """Removes versions before the last `keep`, folders that only these used, and folders of writers that died."""
        numbers = sorted(int(n) for n in self._stat("_versions") if n.isdigit())
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        if not old:
            return
        used = set().union(*(_folders(self._manifest(n)[0]) for n in kept))
        gone = set().union(*(_folders(self._manifest(n)[0]) for n in old)) - used
        for table in TABLES:
            left = {f"{table}/{f}" for f, at in self._stat(table).items() if f.startswith("v-") and time.time() - at > self.orphan_seconds}
            gone |= left - used
        self._drop([*sorted(gone), *(f"_versions/{n:012d}" for n in old)])

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.version())

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    def commit(self, change: Callable[[Transaction], T], base: int | None = None, still: Callable[[], bool] = lambda: True) -> T:
        """Runs change(transaction) and publishes all that it did, at once; returns what it returned. If a newer version has touched what it read or wrote, it is run again on that
        version; with `base`, the version that it has to start from, Conflict is raised instead. still: asked before anything is published; if it says no, nothing is."""
        self._at("_versions")[1].mkdirs(self._at("_versions")[0])
        for _ in range(self.attempts):
            tx = Transaction(self, self.version() if base is None else base)
            published = False
            try:
                out = change(tx)
                if not tx.folders and not tx.demands:
                    return out
                number, after = tx.number, tx.rebased(tx.base, tx.rules)
                while after and not published:
                    if not still():
                        raise TimeoutError("given up before it was published")
                    data = json.dumps({"tables": after[0], "rules": after[1]}).encode()
                    published = self.publish(f"{self.root}/_versions/{number + 1:012d}", data)
                    if not published:
                        number = max(self.version(), number + 1)
                        after = tx.rebased(*self._manifest(number))
            finally:
                if not published:
                    self._drop(tx.folders)
            if published:
                self._drop([f for f in tx.folders if f not in _folders(after[0])])
                self._vacuum()
                return out
            if base is not None:
                break
        raise Conflict(f"no version after {self.attempts if base is None else 1} attempts")

    # Changes of one table

    def write(self, table: str, df: DataFrame, base: int | None = None) -> None:
        """Replaces the whole table. base: the version that df was made from; if the table has changed since, Conflict is raised."""
        self.commit(lambda tx: tx.write(table, df), base)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame], parts: set[str] | None = None) -> None:
        """The table (or the parts that are named) after `change`."""
        self.commit(lambda tx: tx.update(table, change, parts))

    def upsert(self, table: str, new: DataFrame) -> None:
        self.commit(lambda tx: tx.upsert(table, new))

    def delete(self, table: str, keys: DataFrame, on: list[str] | None = None) -> None:
        self.commit(lambda tx: tx.delete(table, keys, on))

    def append(self, table: str, rows: DataFrame) -> None:
        self.commit(lambda tx: tx.append(table, rows))

    def append_log(self, rows: DataFrame, retain: int = 0) -> None:
        self.commit(lambda tx: tx.append_log(rows, retain))

    def mark_processed(self, sessions: DataFrame, now: Column) -> None:
        self.commit(lambda tx: tx.mark_processed(sessions, now))
