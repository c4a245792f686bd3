"""Conversation prefix trie: an LCP-aware external mergesort of turn sequences whose merged stream emits nodes as they are finished."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm._spark import Workspace, maybe_broadcast, small_batches

#: A turn is named by the SHA-256 digest of its role and text; the text's code points (8 bytes) stand behind it.
ITEM, DIGEST = 40, 32


@dataclass(frozen=True)
class Limits:
    """What bounds memory and sets how much runs at once; results don't depend on it. run_bytes: of a sorted run. range_rows: conversations of a range, about; between
    least_ranges and most_ranges are made, from `sampled` conversations for each. splitter_turns: any point of the order may split it, so the splitters' paths are cut there (the
    order itself is that of whole paths). segment_rows: nodes and conversations held back until their parents are finished. folded: ranges whose open ends one task joins."""

    run_bytes: int = 8 << 20
    range_rows: int = 4000
    least_ranges: int = 8
    most_ranges: int = 4096
    sampled: int = 30
    splitter_turns: int = 64
    segment_rows: int = 100_000
    folded: int = 64


NODE = "depth long, conv_id long, turn binary, n_convs long, n_children long, n_leaves long, saved_tokens long"


def conversation_paths(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turn, role, text): conv_id and items, the names of its turns in order (null turn first; turns of one number by their names)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # the length tells where the role ends
    item = F.concat(F.unhex(F.sha2(named.cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.char_length(text).cast("long")), 16, "0")))
    turns = chats.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), item.alias("item")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["item"]).alias("items"))


def rebuilt(paths: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """paths, where the first h turns of each conversation are replaced by those of conversation c - c % every: h = crc32(c) % most. Of the base conversations only
    the first most - 1 turns are moved."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    firsts = paths.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("items", 1, most - 1).alias("first"))
    joined = paths.withColumn("base", base).join(firsts, "base", "left")
    none = F.array().cast("array<binary>")
    own = F.slice("items", h + 1, F.size("items") + 1)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), h), none), own).alias("items"))


def splitters(paths: DataFrame, limits: Limits) -> list[tuple[bytes, int]]:
    """Points that cut the order of (path, conv_id) into about equal ranges, from a sample whose size follows their number. Copies of one path are parted by conv_id."""
    rows, turns = paths.count(), limits.splitter_turns
    n = min(max(rows // limits.range_rows, limits.least_ranges), limits.most_ranges)
    sample = paths.sample(min(1.0, limits.sampled * n / max(rows, 1)), seed=7).select(F.slice("items", 1, turns).alias("items"), (F.size("items") > turns).alias("cut"), "conv_id")
    keys = sorted((b"".join(map(bytes, r["items"])), -(2**63) if r["cut"] else r["conv_id"]) for r in sample.toLocalIterator())
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """The number of equal items at the start of two paths of which `at` are known to be."""
    if a == b:
        return len(a) // ITEM
    most = min(len(a), len(b)) // ITEM
    while at < most and a[at * ITEM : at * ITEM + ITEM] == b[at * ITEM : at * ITEM + ITEM]:
        at += 1
    return at


def sorted_runs(paths: DataFrame, cuts: list[tuple[bytes, int]], run_bytes: int) -> DataFrame:
    """Runs of about run_bytes, sorted by (path, conv_id) and cut at the splitters: range, convs, lcps, sizes and rest. A run carries the length of the
    common prefix (in turns) of each path and the one before it, and of each path only what follows that prefix."""

    def pieces(run: list[tuple[bytes, int]]) -> Iterator[tuple]:
        run.sort()
        bounds = [0, *(bisect_left(run, c) for c in cuts), len(run)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
            if a < b:
                part = run[a:b]
                lcps = [0, *(common(x[0], y[0]) for x, y in zip(part, part[1:]))]  # noqa: B905
                rest = b"".join(p[lcp * ITEM :] for (p, _), lcp in zip(part, lcps, strict=True))
                numbers = (np.array(x, np.int64).tobytes() for x in ([c for _, c in part], lcps, [len(p) // ITEM for p, _ in part]))
                yield (i, *numbers, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces(held), strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["range", "convs", "lcps", "sizes", "rest"])

        for batch in batches:
            items = batch.column("items")
            for i, c in enumerate(batch.column("conv_id").to_pylist()):
                path = b"".join(items[i].as_py())
                held.append((path, c))
                size += len(path) + 64
                if size > run_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return paths.select("conv_id", "items").mapInArrow(run, "range int, convs binary, lcps binary, sizes binary, rest binary")


def read_run(convs: bytes, lcps: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[bytes, int, int]]:
    """path, conv_id and lcp of each conversation of a run."""
    path, at = b"", 0
    for conv, lcp, size in zip(*(np.frombuffer(x, np.int64).tolist() for x in (convs, lcps, sizes)), strict=True):
        to = at + (size - lcp) * ITEM
        path, at = path[: lcp * ITEM] + rest[at:to], to
        yield path, conv, lcp


def merge_runs(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merges sorted runs with a loser tree: path, conv_id and lcp with the one before. A run's head carries its lcp with what went out last, so that two heads
    of different lcps are ordered without a look at them, and others are compared from there on: shared turns aren't compared again."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    tree = [-1] * k  # losers; tree[0] is the winner

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; the loser's lcp becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if x[2] != y[2]:
            return x[2] > y[2]
        same = common(x[0], y[0], x[2])
        first = x[:2] < y[:2] if len(x[0]) == len(y[0]) == same * ITEM else x[0][same * ITEM :] < y[0][same * ITEM :]
        loser = b if first else a
        heads[loser] = (*heads[loser][:2], same)
        return first

    def play(leaf: int) -> None:
        at, winner = (leaf + k) // 2, leaf
        while at:
            if tree[at] < 0:  # the first to arrive waits for its rival
                tree[at] = winner
                return
            if beats(tree[at], winner):
                tree[at], winner = winner, tree[at]
            at //= 2
        tree[0] = winner

    for leaf in range(k):
        play(leaf)
    while k and (head := heads[tree[0]]) is not None:
        yield head
        heads[tree[0]] = next(runs[tree[0]], None)
        play(tree[0])


@dataclass(slots=True)
class Node:
    """An open node. What it counts comes from the conversations that end in it and from finished children. first: it was open when the segment began,
    so that the segment before may hold more of it."""

    depth: int
    turn: bytes
    chars: int
    first: bool
    number: int = 0
    parent: int = 0
    key: bytes = b""
    parent_key: bytes = b""
    n: int = 0
    low: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)

    def add(self, n: int, low: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if low is not None and (self.low is None or low < self.low):
            self.low = low


class OpenPath:
    """The stack of open nodes along a sorted stream. A node is finished when the stream leaves it; finished(node) gets it, unless it was open at the beginning:
    then it waits in `waiting`, and what it has counted isn't yet its parent's."""

    def __init__(self, finished: Callable[[Node], None]):
        self.stack: list[Node] = []
        self.waiting: list[Node] = []
        self.finished = finished

    def close_to(self, depth: int) -> None:
        """Leaves all nodes below depth."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            if node.first:
                self.waiting.append(node)
                continue
            node.saved += (node.n - 1) * node.chars
            node.leaves = node.leaves or 1
            self.finished(node)
            if self.stack:
                self.stack[-1].add(node.n, node.low, 1, node.leaves, node.saved)


def ids_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


#: Rows of a merged range. kind 0: a finished node (parent_conv_id is null if its parent isn't finished: then `parent` is that one's number in the segment). kind 1: a node that is
#: open at the segment's beginning or end, with what it has counted itself; opens: it is open at the beginning; lasts: at the end. kind 2: conversations that end in such a node.
MERGED = f"kind int, segment long, {NODE}, parent_conv_id long, ends_sha256 string, number long, parent long, key binary, parent_key binary, chars long, opens boolean, lasts boolean, ends string"


class Segment:
    """One segment of a range's merged stream: `rows` are those of MERGED once it has ended."""

    def __init__(self, segment: int):
        self.segment, self.path, self.start = segment, None, b""
        self.open = OpenPath(self._finish)
        self.nodes: list[tuple[Node, str]] = []
        self.count = self.convs = 0

    def _finish(self, node: Node) -> None:
        self.nodes.append((node, hashlib.sha256(ids_text(node.ends).encode()).hexdigest()))
        node.ends = []

    def add(self, path: bytes, conv: int, lcp: int) -> None:
        first = self.path is None
        if first:
            lcp, self.start = -1, path
        self.open.close_to(lcp)
        stack = self.open.stack
        for depth in range(lcp + 1, len(path) // ITEM + 1):
            item = path[depth * ITEM - ITEM : depth * ITEM] if depth else b""
            stack.append(Node(depth, item[:DIGEST], int.from_bytes(item[DIGEST:], "big"), first, number=self.count, parent=stack[-1].number if stack else -1))
            self.count += 1
        stack[-1].add(1, conv, 0, 0, 0)
        stack[-1].ends.append(conv)
        self.path, self.convs = path, self.convs + 1

    def rows(self) -> Iterator[dict]:
        low = {node.number: node.low for node, _ in self.nodes}
        for node, ends in self.nodes:
            yield self._row(0, node) | {"parent_conv_id": low.get(node.parent), "ends_sha256": ends, "parent": node.parent}
        lasting = {id(n) for n in self.open.stack}
        for path, nodes in ((self.start, [n for n in (*self.open.waiting, *self.open.stack) if n.first]), (self.path or b"", [n for n in self.open.stack if not n.first])):
            keys, name = [hashlib.sha256().digest()], hashlib.sha256()
            for i in range(0, len(path), ITEM):
                name.update(path[i : i + ITEM])
                keys.append(name.copy().digest())
            for node in nodes:
                node.key, node.parent_key = keys[node.depth], keys[node.depth - 1] if node.depth else b""
                yield self._row(1, node) | {"opens": node.first, "lasts": id(node) in lasting}
                if node.ends:
                    yield dict(kind=2, segment=self.segment, key=node.key, ends=ids_text(node.ends))

    def _row(self, kind: int, n: Node) -> dict:
        return _row(n) | dict(kind=kind, segment=self.segment)


def _row(n: Node) -> dict:
    return dict(
        depth=n.depth, conv_id=n.low, turn=n.turn, n_convs=n.n, n_children=n.children, n_leaves=n.leaves, saved_tokens=n.saved, number=n.number, key=n.key, parent_key=n.parent_key, chars=n.chars
    )


def _node(r: dict, first: bool) -> Node:
    return Node(r["depth"], r["turn"], r["chars"], first, key=r["key"], parent_key=r["parent_key"])


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append({c: row.get(c) for c in schema.names})
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in ddl.split(", "))])


def merged_ranges(runs: DataFrame, ranges: int, segment_rows: int) -> DataFrame:
    """Merges the runs of each range: rows of MERGED. A segment ends with its range, or when it holds segment_rows finished nodes and conversations."""
    placed = runs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        every = (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True)) for batch in batches for i in range(batch.num_rows))
        for place, parts in groupby(every, lambda r: r["range"]):
            segment = Segment(place << 32)
            for path, conv, lcp in merge_runs([read_run(p["convs"], p["lcps"], p["sizes"], p["rest"]) for p in parts]):
                if len(segment.nodes) + segment.convs >= segment_rows:
                    yield from segment.rows()
                    segment = Segment(segment.segment + 1)
                segment.add(path, conv, lcp)
            yield from segment.rows()

    return placed.mapInArrow(lambda batches: _batches(rows(batches), _arrow(MERGED)), MERGED)


#: Rows of folded open ends. done: the node is finished.
FOLDS = f"done boolean, segment long, {NODE}, key binary, parent_key binary, chars long, opens boolean, lasts boolean"


def fold_segments(ends: DataFrame, groups: int, last: bool) -> DataFrame:
    """Joins the open ends of neighbouring segments (rows of FOLDS, grouped by the column `fold`): nodes that the stream leaves within a group are finished, and those open at the group's
    beginning or end are its own open ends. last: nothing comes before or after, so all are finished."""
    columns = [c.split()[0] for c in FOLDS.split(", ") if c != "done boolean"]
    # Of a segment, nodes that are open at the beginning come first, and then those that are open only at the end, each from the root down.
    placed = ends.select("fold", *columns).repartitionById(groups, F.col("fold")).sortWithinPartitions("fold", "segment", F.col("opens").desc(), "depth")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        every = (r for batch in batches for r in batch.to_pylist())
        for group, of_group in groupby(every, lambda r: r["fold"]):
            finished: list[dict] = []
            path = OpenPath(lambda n: finished.append(_row(n) | {"done": True}))  # noqa: B023
            stack, begun = path.stack, last
            for _, of_segment in groupby(of_group, lambda r: r["segment"]):
                ends = list(of_segment)  # two paths
                opens = [r for r in ends if r["opens"]]
                same = next((d for d, r in enumerate(opens) if d >= len(stack) or stack[d].key != r["key"]), len(opens))
                path.close_to(same - 1)
                for r in opens:
                    if r["depth"] >= same:
                        stack.append(_node(r, first=not begun))
                    stack[r["depth"]].add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
                path.close_to(sum(r["lasts"] for r in opens) - 1)
                for r in ends[len(opens) :]:
                    stack.append(_node(r, first=False))
                    stack[-1].add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
                begun = True
                yield from finished
                finished.clear()
            if last:
                path.close_to(-1)
                yield from finished
                continue
            lasting = {id(n) for n in stack}
            for n in (*path.waiting, *stack):
                yield _row(n) | dict(done=False, segment=group, opens=n.first, lasts=id(n) in lasting)

    return placed.mapInArrow(lambda batches: _batches(rows(batches), _arrow(FOLDS)), FOLDS)


def end_digests(ends: DataFrame) -> DataFrame:
    """ends (key, segment, ends: ids in order): key and ends_sha256 of the ids of all segments, comma-joined. The texts of a node stream through its digest, one at a time."""
    ordered = ends.select("key", "segment", "ends").repartition("key").sortWithinPartitions("key", "segment")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        every = (r for batch in batches for r in batch.to_pylist())
        for key, parts in groupby(every, lambda r: r["key"]):
            name = hashlib.sha256()
            for i, part in enumerate(parts):
                name.update((("," if i else "") + part["ends"]).encode())
            yield dict(key=key, ends_sha256=name.hexdigest())

    ddl = "key binary, ends_sha256 string"
    return ordered.mapInArrow(lambda batches: _batches(rows(batches), _arrow(ddl)), ddl)


def prefix_trie(paths: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """paths (conv_id, items as of conversation_paths, one row per conversation): one row per node of the trie of their turns, the textless root included: conv_id (its smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree, (n_convs - 1) times the code points of each node's last
    text), ends_sha256 (of the ids that end there, ascending, comma-joined) and turn_sha256 (name of its last turn; '' at the root; see turn_texts).

    Conversations are dealt to ranges of the order (path, conv_id), so that neither a common beginning nor a group of copies makes a range large, and sorted there as runs that a
    loser tree merges. Nodes inside a range are finished there; those open at its ends are joined with its neighbours', some ranges at a time and level by level, up to the root.
    Equal turns are told by the SHA-256 digest of role and text. A conversation's own names have to fit into a task (40 bytes a turn), its texts don't.
    """
    spark = paths.sparkSession
    small_batches(spark)
    work = Workspace(spark, "trie")
    paths = work.write(paths.select("conv_id", "items"), "paths")
    cuts = splitters(paths, limits)
    ranges = len(cuts) + 1
    merged = work.write(merged_ranges(sorted_runs(paths, cuts, limits.run_bytes), ranges, limits.segment_rows), "merged")
    open_ends = merged.filter("kind = 1")

    ends = open_ends.withColumn("place", F.shiftright("segment", 32))
    folded, level, groups = None, 0, ranges
    while groups > 1 or not level:
        groups = -(-groups // limits.folded)
        found = work.write(fold_segments(ends.withColumn("fold", F.expr(f"cast(place div {limits.folded} as int)")), groups, groups == 1), f"fold{level}")
        done = found.filter("done")
        folded = done if folded is None else folded.unionAll(done)
        ends, level = found.filter("not done").withColumn("place", F.col("segment")), level + 1

    joined = work.write(folded.join(end_digests(merged.filter("kind = 2")), "key", "left"), "joined")
    low = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    measures = [c.split()[0] for c in NODE.split(", ")]
    outer = joined.join(low, "parent_key", "left").select(*measures, "parent_conv_id", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    inner = merged.filter("kind = 0")
    numbers = open_ends.select("segment", F.col("number").alias("parent"), "key").join(low.withColumnRenamed("parent_key", "key"), "key").drop("key")
    hung = inner.filter("parent_conv_id is null").drop("parent_conv_id").join(maybe_broadcast(numbers), ["segment", "parent"])
    rows = [df.select(*measures, "parent_conv_id", "ends_sha256") for df in (outer, inner.filter("parent_conv_id is not null"), hung)]
    nodes = rows[0].unionAll(rows[1]).unionAll(rows[2])
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.lower(F.hex("turn")).alias("turn_sha256")
    )


def turn_texts(nodes: DataFrame, chats: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn (null at the root), found by its name."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = chats.select(F.sha2(named.cast("binary"), 256).alias("turn_sha256"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_sha256"])
    return nodes.join(turns, "turn_sha256", "left")


def conversation_trie(chats: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """chats (conv_id, turn, role, text; more columns are ignored): the prefix trie of their conversations, each rebuilt first (see `rebuilt` and prefix_trie).

    Null roles and texts are empty, null turns come first; turns of one number are ordered by their names (equal rows are turns of their own). Rows of null conv_id belong
    to no conversation. A rebuilt conversation without turns is a member of the root only. An empty table gives no nodes. Texts of any length are named once, where they are read.
    """
    return prefix_trie(rebuilt(conversation_paths(chats), every, most))
