"""Removal of repeated substrings by prefix-free parsing.

A rolling hash over short grams sets triggers: each window of `length` bytes is triggered by its smallest
gram. Runs of windows with one trigger are a phrase; phrases overlap by length - 1 bytes, so each window
lies in just one. The parse is the sequence of a text's phrases; the dictionary holds each different phrase
once, with the first text that has it. Two parts give the order of all windows, cut to `length` bytes, in the corpus:

* Within phrases, the dictionary's suffix array. Equal windows have equal triggers at equal places, so it falls into independent parts, one per
  trigger, and only triggers with several phrases have anything to order.
* Among phrases, the parse's suffix array. As no window reaches beyond its phrase, suffixes of the parse are ordered by
  their first phrase alone, ties by place in the corpus; and of each run of equal ones only the first is asked for. So that array isn't
  written down: its runs are the groups of equal phrases, and each run's head is the smallest place, by aggregation.

A window is a repeat if it isn't the first of its run. Inside one text, where places are known without an exchange, runs are found by names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import Workspace, small_batches

#: Bytes of a gram, and window starts handled at once (their places have to fit 24 bits).
GRAM, SEGMENT = 24, 1 << 22
PLACE = np.uint64((1 << 24) - 1)
#: Dictionary phrases put in order at once (and the rest of the last one's trigger).
BLOCK = 4096


def gram_keys(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (three times eight) bytes from each place. Grams that share one become one trigger, which does no harm."""
    code = T.codes(data)
    count = max(len(data) - GRAM + 1, 0)
    key = np.zeros(count, dtype=np.uint64)
    for j in range(0, GRAM, 8):
        key = T.mix((key ^ code[j : j + count]) + T.MULTIPLIERS[20 + j])
    return key


def gram_keys_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """gram_keys of some places."""
    code = data[at[:, None] + np.arange(GRAM)].view("<u8")
    key = np.zeros(len(at), dtype=np.uint64)
    for j in range(GRAM // 8):
        key = T.mix((key ^ code[:, j]) + T.MULTIPLIERS[20 + 8 * j])
    return key


class Parse:
    """Phrases of a chunk's documents, in order. Phrase i has windows first[i]..last[i] (starts) and trigger at[i]."""

    def __init__(self, chunk: T.Chunk, length: int):
        self.chunk, self.length = chunk, length
        data = chunk.data
        n = len(data)
        self.own = T.Names(data, T.EXACT)
        width = length - GRAM + 1
        windows = np.maximum(np.diff(chunk.bounds) - length + 1, 0)
        valid = np.zeros(n, dtype=bool)
        steps = np.zeros(n + 1, dtype=np.int64)
        has = windows > 0
        steps[chunk.bounds[:-1][has]] += 1
        np.add.at(steps, (chunk.bounds[:-1] + windows)[has], -1)
        valid = np.cumsum(steps[:-1]) > 0
        starts, triggers = [], []
        for low in range(0, n, SEGMENT):
            mine = np.flatnonzero(valid[low : low + SEGMENT])
            if not len(mine):
                continue
            grams = gram_keys(data[low : min(low + SEGMENT + width + GRAM - 1, n)])
            key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while span * 2 <= width:
                key = np.minimum(key[: len(key) - span], key[span:])
                span *= 2
            if span < width:
                key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
            starts.append(mine + low)
            triggers.append((key[mine] & PLACE).astype(np.int64) + low)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        trigger = np.concatenate(triggers) if triggers else np.zeros(0, np.int64)
        new = np.ones(len(start), dtype=bool)
        # A new phrase where the trigger moves on. Triggers of different texts always differ.
        new[1:] = trigger[1:] != trigger[:-1]
        begins = np.flatnonzero(new)
        self.first = start[begins]
        self.last = start[np.concatenate((begins[1:], [len(start)])) - 1] if len(begins) else begins
        self.at = trigger[begins]
        self.doc = np.searchsorted(chunk.bounds, self.first, side="right") - 1
        self.bounds = np.searchsorted(self.first, chunk.bounds)
        self.key = gram_keys_at(data, self.at)
        self.phrase = T.mix(self.names(self.first, self.last - self.first + length) + (self.at - self.first).astype(np.uint64) * T.MULTIPLIERS[50])

    def names(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """64-bit names of byte ranges."""
        return self.own.of(starts, starts + sizes)

    def first_in_doc(self) -> np.ndarray:
        """If a phrase is the first of its kind in its document."""
        key = T.mix(T.mix(self.key ^ T.mix(self.doc.astype(np.uint64))) ^ self.phrase)
        firsts = np.zeros(len(key), dtype=bool)
        firsts[np.unique(key, return_index=True)[1]] = True
        return firsts

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of the phrases `which` (increasing), and the phrase of each."""
        sizes = self.last[which] - self.first[which] + 1
        phrase = np.repeat(which, sizes)
        return np.arange(len(phrase)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[which], sizes), phrase

    def repeated_in_doc(self) -> np.ndarray:
        """Starts of windows that start earlier in the same document, too."""
        key = T.mix(self.key ^ T.mix(self.doc.astype(np.uint64)))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        start, phrase = self.windows(np.flatnonzero(counts[inverse] > 1))
        names = T.mix(T.mix(self.names(start, self.length) ^ self.key[phrase]) ^ T.mix(self.doc[phrase].astype(np.uint64)))
        again = np.ones(len(start), dtype=bool)
        again[np.unique(names, return_index=True)[1]] = False
        return start[again]


def _parse_rows(docs: DataFrame, length: int) -> DataFrame:
    """k (trigger), h (phrase), doc_id and idx (the phrase's place in its document), once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in T.chunks(batch.column("text")):
                p = Parse(chunk, length)
                use = np.flatnonzero(p.first_in_doc())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p.key[use].view(np.int64)),
                        pa.array(p.phrase[use].view(np.int64)),
                        pa.array(ids[chunk.first + p.doc[use]].astype(np.int64)),
                        pa.array((use - p.bounds[p.doc[use]]).astype(np.int32)),
                    ],
                    ["k", "h", "doc_id", "idx"],
                )

    return docs.mapInArrow(run, "k long, h long, doc_id long, idx int")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and z, the compressed text: what has to be brought together with a document's marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            column = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack(x) for x in column.to_pylist()], pa.binary())], ["doc_id", "z"])

    return docs.mapInArrow(run, "doc_id long, z binary")


def _texts(batch: pa.RecordBatch) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in batch.column("z").to_pylist()], pa.large_binary())


def _part_phrases(batch: pa.RecordBatch, length: int) -> Iterator[tuple[Parse, np.ndarray]]:
    """The parse of each chunk of a batch with `part` (places of some phrases), and those phrases."""
    part = batch.column("part")
    for chunk in T.chunks(_texts(batch)):
        p = Parse(chunk, length)
        which = [part[chunk.first + i].values.to_numpy().astype(np.int64) + p.bounds[i] for i in range(len(chunk)) if part[chunk.first + i].is_valid]
        yield p, np.sort(np.concatenate(which)) if which else np.zeros(0, np.int64)


def _dictionary_rows(docs: DataFrame, length: int) -> DataFrame:
    """docs with `part`: k, doc_id, place (of its first window) and letters of these phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for p, which in _part_phrases(batch, length):
                first, stop = p.first[which], p.last[which] + length
                raw = p.chunk.data.tobytes()
                letters = pa.array([raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary())
                place = first - p.chunk.bounds[p.doc[which]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p.key[which].view(np.int64)),
                        pa.array(ids[p.chunk.first + p.doc[which]].astype(np.int64)),
                        pa.array(place.astype(np.int32)),
                        letters,
                    ],
                    ["k", "doc_id", "place", "letters"],
                )

    return docs.mapInArrow(run, "k long, doc_id long, place int, letters binary")


def suffix_order(chunk: T.Chunk, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, by letters, of the suffixes at `starts` that agree with another one in their first `length` letters, and
    where it goes on to other letters (the longest common prefix with the suffix before falls under `length`). Suffixes that agree keep the order they
    have in `starts`. All others are put aside by a hash first, so that only what repeats is sorted.
    """
    _, inverse, counts = np.unique(T.Names(chunk.data, T.EXACT).of(starts, starts + length), return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    eight = np.lib.stride_tricks.sliding_window_view(chunk.data, 8)
    steps = [*range(0, length - 8, 8), length - 8]
    words = [eight[starts[some] + s].view(">u8").ravel().astype(np.uint64) for s in steps]
    order = np.lexsort(words[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for w in words:
            by = w[order]
            new[1:] |= by[1:] != by[:-1]
    return some[order], new


def _repeats_in_order(rows: DataFrame, length: int) -> DataFrame:
    """_dictionary_rows, all of a trigger in one part and in corpus order: doc_id, first and last of the runs of windows that
    an earlier document has, too."""

    def repeats(table: pa.Table) -> pa.RecordBatch:
        doc = table.column("doc_id").to_numpy()
        chunk = next(T.chunks(table.column("letters").combine_chunks().cast(pa.large_binary()), 1 << 40))
        sizes = np.diff(chunk.bounds) - length + 1
        phrase = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(phrase)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, new = suffix_order(chunk, chunk.bounds[phrase] + offset, length)
        # Suffixes that agree in `length` letters stand together, and as they came: the first of them is that of the first document.
        group = np.cumsum(new) - 1
        again = np.zeros(len(phrase), dtype=bool)
        again[order] = doc[phrase[order]] > doc[phrase[order[np.flatnonzero(new)[group]]]]
        joined = again[1:] & again[:-1] & (phrase[1:] == phrase[:-1])
        opens = np.flatnonzero(again & ~np.concatenate(([False], joined)))
        closes = np.flatnonzero(again & ~np.concatenate((joined, [False])))
        place = table.column("place").to_numpy()[phrase[opens]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[phrase[opens]]),
                pa.array((place + offset[opens]).astype(np.int32)),
                pa.array((place + offset[closes]).astype(np.int32)),
            ],
            ["doc_id", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < BLOCK:
                continue
            table = pa.concat_tables(held)
            # The last trigger may go on in the next batch.
            k = table.column("k").to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield repeats(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield repeats(pa.concat_tables(held))

    return rows.repartition("k").sortWithinPartitions("k", "doc_id", "place").mapInArrow(run, "doc_id long, first int, last int")


def _window_rows(docs: DataFrame, length: int) -> DataFrame:
    """docs with `part`: k, w (name), doc_id and place of each window of these phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for p, which in _part_phrases(batch, length):
                start, phrase = p.windows(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p.key[phrase].view(np.int64)),
                        pa.array(p.names(start, length).view(np.int64)),
                        pa.array(ids[p.chunk.first + p.doc[phrase]].astype(np.int64)),
                        pa.array((start - p.chunk.bounds[p.doc[phrase]]).astype(np.int32)),
                    ],
                    ["k", "w", "doc_id", "place"],
                )

    return docs.mapInArrow(run, "k long, w long, doc_id long, place int")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, z, `phrases` (places of phrases that are repeats) and `runs` (first and last of further windows that are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, runs = batch.column("phrases"), batch.column("runs")
            for chunk in T.chunks(_texts(batch)):
                p = Parse(chunk, length)
                steps = np.zeros(len(chunk.data) + 1, dtype=np.int64)
                again = p.repeated_in_doc()
                np.add.at(steps, again, 1)
                np.add.at(steps, again + length, -1)
                for i in range(len(chunk)):
                    row = chunk.first + i
                    if phrases[row].is_valid:
                        which = np.asarray(phrases[row].values.to_numpy(), dtype=np.int64) + p.bounds[i]
                        np.add.at(steps, p.first[which], 1)
                        np.add.at(steps, p.last[which] + length, -1)
                    if runs[row].is_valid:
                        own = runs[row].values
                        np.add.at(steps, own.field("first").to_numpy().astype(np.int64) + chunk.bounds[i], 1)
                        np.add.at(steps, own.field("last").to_numpy().astype(np.int64) + chunk.bounds[i] + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
                inner = chunk.bounds[:-1][chunk.bounds[:-1] < len(gone)]
                before[inner] = False
                after = np.concatenate((gone[1:], [False])) if len(gone) else gone
                ends = chunk.bounds[1:][chunk.bounds[1:] > 0] - 1
                after[ends] = False
                opens, closes = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
                by = np.searchsorted(opens, chunk.bounds)
                shift = np.repeat(chunk.bounds[:-1], np.diff(by))
                kept_before = np.concatenate(([0], np.cumsum(~gone)))[chunk.bounds]
                spans = pa.StructArray.from_arrays([pa.array(opens - shift, pa.int64()), pa.array(closes - shift, pa.int64())], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, len(chunk)),
                        pa.array(np.diff(chunk.bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), spans),
                        pa.Array.from_buffers(
                            pa.large_binary(),
                            len(chunk),
                            [None, pa.py_buffer(kept_before.astype(np.int64).tobytes()), pa.py_buffer(chunk.data[~gone].tobytes())],
                        ).cast(pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 100, group: int = 16384) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts earlier: in a text of smaller doc_id, or
    earlier in the same one. Strings never cross texts and are judged on the input.

    docs: doc_id, text (more columns are ignored). Returns one row per row: doc_id, n_bytes (UTF-8), spans
    (maximal removed runs, start and end in bytes), kept (the remaining bytes, which may cut a character). Null and
    shorter texts stay whole. Rows that share a doc_id aren't earlier than each other; rows of null doc_id are only
    compared with themselves. An empty table gives no rows.

    A trigger with more than one phrase is put in order by one task, unless it has over `group` phrases: then each of its windows is
    a row of its own, and a run of equal windows is a group of rows (told apart by 64-bit names modulo a prime) whose head is
    aggregated, which splits at any size.
    """
    if length <= GRAM:
        raise ValueError(f"length has to exceed {GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "substring_dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.filter("doc_id is not null")

    parse = _parse_rows(named, length)
    # Counts are written before they are joined back, so that Spark can split a trigger with very many rows in that join.
    shared = work.write(parse.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "shared")
    work.release()
    common = work.write(parse.join(shared, "k"), "common")
    del parse, shared
    work.release()
    # The dictionary: each phrase with its first text; and the triggers with more than one phrase.
    dictionary = work.write(common.groupBy("k", "h").agg(F.min("doc_id").alias("first")), "dictionary")
    many = work.write(dictionary.groupBy("k").agg(F.count("*").alias("phrases")).filter("phrases > 1"), "many")
    placed = common.join(dictionary, ["k", "h"])
    whole = placed.filter("doc_id > first").select("doc_id", "idx", F.lit(None).cast("struct<first:int,last:int>").alias("run"))
    part = work.write(placed.filter("doc_id = first").join(many, "k").select("doc_id", "idx", (F.col("phrases") > group).alias("large")), "part")

    def with_part(rows: DataFrame) -> DataFrame:
        return _packed(named).join(rows.groupBy("doc_id").agg(F.collect_list("idx").alias("part")), "doc_id")

    again = _repeats_in_order(_dictionary_rows(with_part(part.filter("not large")), length), length)
    if part.filter("large").limit(1).count():
        windows = work.write(_window_rows(with_part(part.filter("large")), length), "windows")
        earliest = work.write(windows.groupBy("k", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"), "earliest")
        far = windows.join(earliest.select("k", "w", F.col("first").alias("f")), ["k", "w"]).filter("doc_id > f")
        again = again.unionByName(far.select("doc_id", F.col("place").alias("first"), F.col("place").alias("last")))
    again = work.write(again, "again").select("doc_id", F.lit(None).cast("int").alias("idx"), F.struct("first", "last").alias("run"))
    marks = whole.unionByName(again).groupBy("doc_id").agg(F.collect_set("idx").alias("phrases"), F.collect_set("run").alias("runs"))
    marks = work.write(marks, "marks")
    del placed, whole, again
    work.keep_only("marks")
    work.release()
    return _cut(_packed(docs).join(marks, "doc_id", "left"), length)
