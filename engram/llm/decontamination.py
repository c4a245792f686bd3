"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import small_batches

#: Bytes of benchmark text that are searched for at once, and of documents that a task holds while it goes through the blocks
#: of a benchmark with more text than that.
BLOCK_BYTES, HELD_BYTES = 16 << 20, 64 << 20
#: Words in a block of the shift table, and bits of its index.
BLOCK, TABLE_BITS = 2, 18


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of [0-9a-z] and non-ASCII characters."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    chunk = T.Chunk(data, np.array([0, len(data)]), 0)
    starts, ends, _ = chunk.words(T.ALNUM)
    low = T.LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class WuManber:
    """Searches for all patterns of one length m (in words)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.items = list(patterns.values())
        self.words = list(patterns)
        self.m = len(self.words[0])
        self.b = min(BLOCK, self.m)
        flat = [w for p in self.words for w in p]
        data = np.frombuffer(b"".join(flat), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in flat])
        chunk = T.Chunk(data, np.array([0, len(data)]), 0)
        hashes = chunk.hashes(np.concatenate(([0], ends[:-1])), ends, T.FOLDED).reshape(len(self.words), self.m)
        # shift[block]: how far the window may move on when it ends with that block.
        self.shift = np.full(1 << TABLE_BITS, self.m - self.b + 1, dtype=np.int8 if self.m < 120 else np.int32)
        for end in range(self.b, self.m + 1):
            np.minimum.at(self.shift, self.index(self.blocks(hashes[:, end - self.b : end])), self.m - end)
        # Buckets by the hash of the last block; within them, patterns are told apart by the whole sequence's hash.
        self.bucket: dict[int, list[int]] = defaultdict(list)
        whole = T.mix((hashes * T.MULTIPLIERS[: self.m] if self.m <= 50 else hashes * np.resize(T.MULTIPLIERS, self.m)).sum(axis=1, dtype=np.uint64))
        self.suffix = np.unique(self.blocks(hashes[:, self.m - self.b :]))
        for i, w in enumerate(whole.tolist()):
            self.bucket[w].append(i)
        self.whole = np.unique(whole)

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        total = hashes[:, 0] * T.MULTIPLIERS[40]
        for j in range(1, self.b):
            total = total + hashes[:, j] * T.MULTIPLIERS[40 + j]
        return T.mix(total)

    @staticmethod
    def index(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def block_at(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Blocks that end before the word positions `ends`."""
        return self.blocks(np.stack([hashes[ends - self.b + j] for j in range(self.b)], axis=1))

    def search(self, hashes: np.ndarray, same_doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start word, pattern) of sequences whose hash equals a pattern's; same_doc: the document of each word."""
        n, m = len(hashes), self.m
        if n < m:
            return
        # Every occurrence ends within m - b words behind a multiple of that stride. So windows are tried at these
        # ends only, and the shift found there says how many of the ends behind it are impossible.
        stride = m - self.b + 1
        probes = np.arange(m, n + stride, stride)
        probes = np.minimum(probes, n)
        shift = self.shift[self.index(self.block_at(hashes, probes))].astype(np.int64)
        live = shift < stride
        probes, shift = probes[live], shift[live]
        ends = (probes[:, None] + np.arange(stride)[None, :])[np.arange(stride)[None, :] >= shift[:, None]]
        ends = np.unique(ends[ends <= n])
        blocks = self.block_at(hashes, ends)
        ends = ends[self.shift[self.index(blocks)] == 0] if len(ends) else ends
        if not len(ends):
            return
        blocks = self.block_at(hashes, ends)
        ends = ends[np.isin(blocks, self.suffix)]
        ends = ends[same_doc[ends - 1] == same_doc[ends - m]]
        if not len(ends):
            return
        factors = T.MULTIPLIERS[:m] if m <= 50 else np.resize(T.MULTIPLIERS, m)
        total = np.zeros(len(ends), dtype=np.uint64)
        for j in range(m):
            total += hashes[ends - m + j] * factors[j]
        total = T.mix(total)
        hit = np.isin(total, self.whole)
        for end, key in zip(ends[hit].tolist(), total[hit].tolist(), strict=True):
            for pattern in self.bucket[key]:
                yield end - m, pattern


def searchers(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """One searcher for each pattern length: windows of `window` words, or whole shorter items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(dict)
    for item, text in items:
        words = item_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m].setdefault(tuple(words[i : i + m]), set()).add(item)
    return [WuManber(p) for _, p in sorted(by_length.items())]


class Scan:
    """The hits in a chunk, gathered over several searchers."""

    def __init__(self, chunk: T.Chunk):
        self.chunk, self.low = chunk, None
        self.starts, self.ends, self.first = chunk.words(T.ALNUM)
        self.hashes = chunk.hashes(self.starts, self.ends, T.FOLDED)
        self.doc = np.repeat(np.arange(len(chunk)), np.diff(self.first))
        self.steps = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        self.found: list[set[str]] = [set() for _ in range(len(chunk))]

    def search(self, engines: list[WuManber]) -> None:
        sure: dict[tuple[int, int, bytes], bool] = {}
        for number, engine in enumerate(engines):
            for at, pattern in engine.search(self.hashes, self.doc):
                if self.low is None:
                    self.low = T.LOWER[self.chunk.data].tobytes()
                # Direct comparison: each word's bytes.
                key = (number, pattern, self.low[self.starts[at] : self.ends[at + engine.m - 1]])
                if key not in sure:
                    sure[key] = all(self.low[self.starts[at + j] : self.ends[at + j]] == w for j, w in enumerate(engine.words[pattern]))
                if sure[key]:
                    self.steps[at] += 1
                    self.steps[at + engine.m] -= 1
                    self.found[self.doc[at]] |= engine.items[pattern]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """n_words and n_hit of each document."""
        hit = np.concatenate(([0], np.cumsum(np.cumsum(self.steps[:-1]) > 0)))
        return np.diff(self.first), np.diff(hit[self.first])


Block = list[tuple[str, str | None]]


def scan_batches(
    batches: Iterator[pa.RecordBatch],
    text_at: int,
    blocks: list[Broadcast],
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[set[str]]]]:
    """Each batch with n_words, n_hit and the items found of its rows. With several blocks of the benchmark, batches of HELD_BYTES are
    searched for one block after the other, so that a task never holds the searchers of more than one; these come built, as tables."""
    engines = pickle.loads(blocks[0].value) if len(blocks) == 1 else None

    def searched(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[set[str]]]]:
        scans = [[Scan(chunk) for chunk in T.chunks(batch.column(text_at))] for batch in held]
        for block in blocks:
            own = pickle.loads(block.value) if engines is None else engines
            for scan in (s for part in scans for s in part):
                scan.search(own)
        for batch, part in zip(held, scans, strict=True):
            counts = [s.counts() for s in part]
            n, k = (np.concatenate([c[i] for c in counts]).astype(np.int64) if counts else np.zeros(0, np.int64) for i in (0, 1))
            yield batch, n, k, [f for s in part for f in s.found]

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if engines is not None or size >= HELD_BYTES:
            yield from searched(held)
            held, size = [], 0
    if held:
        yield from searched(held)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: int = 20) -> DataFrame:
    """docs (doc_id, text) against benchmark (item_id, text); more columns are ignored.

    Returns per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window of an item),
    n_items, item_ids (sorted as strings, comma-joined), contaminated (n_hit > 0 and min_share * n_hit >= n_words). Null and
    empty texts have no words and aren't contaminated; wordless items have no window. Items sharing an id count as
    one item, repeated rows of docs are judged one by one; an empty benchmark finds nothing. A null item_id counts as an item
    named "". The benchmark doesn't grow with the corpus; it is broadcast in blocks of BLOCK_BYTES of text, of which a task
    searches for one at a time.
    """
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, k, found in scan_batches(batches, 1, blocks):
            items = [",".join(sorted(x)) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n),
                    pa.array(k),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array(items, pa.string()),
                    pa.array((k > 0) & (min_share * k >= n)),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"],
            )

    return narrow.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, item_ids string, contaminated boolean")


def _blocks(benchmark: DataFrame, window: int) -> list[Broadcast]:
    """The searchers of the rows, block by block, built once and broadcast. The driver holds one block at a time."""
    context, blocks = benchmark.sparkSession.sparkContext, []
    block: Block = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        if size > BLOCK_BYTES:
            blocks.append(context.broadcast(pickle.dumps(searchers(block, window))))
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t or "")
    return [*blocks, context.broadcast(pickle.dumps(searchers(block, window)))]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: int = 20) -> DataFrame:
    """The rows of docs that find_contamination doesn't call contaminated, with all their columns. Rows with null or empty
    texts stay, repeated rows share their fate, and an empty table or benchmark drops nothing."""
    small_batches(docs.sparkSession)
    blocks, text_at = _blocks(benchmark, window), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, k, _ in scan_batches(batches, text_at, blocks):
            yield batch.filter(pa.array(~((k > 0) & (min_share * k >= n))))

    return docs.mapInArrow(run, docs.schema)
