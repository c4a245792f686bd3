"""Quality rules, with a suffix array per text whose longest-common-prefix values give its repeated substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import small_batches

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Words from which a repeat counts, the largest share of words in such repeats, and the longest repeat in words.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.30, 120


def suffix_lcp(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a run of texts (equal words have equal names, doc is each word's text), restricted to
    suffixes that share their first word with another of the same text, by prefix doubling; and the longest common
    prefix, in words, of each with the one before it in order (0 for the first of a group). Prefixes end with their text.
    """
    n = len(names)
    _, rank = np.unique(T.mix(names ^ T.mix(doc.astype(np.uint64))), return_inverse=True)
    sizes = np.bincount(rank)
    active = np.flatnonzero(sizes[rank] > 1)
    if not len(active):
        return active, active
    order = active[np.argsort(rank[active], kind="stable")]
    # Ranks are the place where a group begins; all other suffixes get ranks of their own, below zero.
    place = -np.arange(n, dtype=np.int64) - 2
    sorted_rank = rank[order]
    new = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    place[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    suffix = order.copy()
    levels, h = [place.copy()], 1
    while True:
        begins = place[suffix]
        counts = np.bincount(begins, minlength=len(suffix))
        open_ = np.flatnonzero(counts[begins] > 1)
        if not len(open_):
            break
        part = suffix[open_]
        after = part + h
        inside = after < n
        second = np.full(len(part), -1, dtype=np.int64)  # the text ends: before all others
        same = np.zeros(len(part), dtype=bool)
        same[inside] = doc[after[inside]] == doc[part[inside]]
        second[same] = place[after[same]] + n + 2
        second[~same] = -part[~same] - 1  # two ends of one text never tie
        key = np.lexsort((second, begins[open_]))
        part, first, second = part[key], begins[open_][key], second[key]
        suffix[open_] = part
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        place[part] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(place.copy())
        h *= 2
    lcp = np.zeros(len(suffix), dtype=np.int64)
    left, right = suffix[:-1].copy(), suffix[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        ok = (left < n) & (right < n)
        equal = np.zeros(len(left), dtype=bool)
        equal[ok] = levels[level][left[ok]] == levels[level][right[ok]]
        lcp[1:][equal] += 1 << level
        left[equal] += 1 << level
        right[equal] += 1 << level
    return suffix, lcp


def repeated_spans(suffix: np.ndarray, lcp: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n words, if a maximal repeat of at least `least` words covers it, and the longest repeat from there."""
    longest = np.zeros(n, dtype=np.int64)
    if len(suffix):
        longest[suffix] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    at = np.flatnonzero(longest >= least)
    steps = np.zeros(n + 1, dtype=np.int64)
    steps[at] += 1
    np.add.at(steps, at + longest[at], -1)
    return np.cumsum(steps[:-1]) > 0, longest


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds."""
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[first][1:] - np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[first][:-1]


def repeated_lines(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, names: np.ndarray) -> np.ndarray:
    """If a line is equal to an earlier one of its text. Names only say which lines to compare; their bytes decide."""
    _, inverse, counts = np.unique(T.mix(names ^ T.mix(doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    dup = np.zeros(len(names), dtype=bool)
    seen: set[tuple[int, bytes]] = set()
    for i in np.flatnonzero(counts[inverse] > 1).tolist():
        line = (int(doc[i]), data[start[i] : end[i]].tobytes())
        dup[i] = line in seen
        seen.add(line)
    return dup


def chunk_stats(chunk: T.Chunk, least: int) -> dict[str, np.ndarray]:
    starts, ends, first = chunk.words(T.NOT_SPACE)
    names = T.Names(chunk.data, T.EXACT)
    hashes = names.of(starts, ends)
    docs = len(chunk)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(docs), n_words)
    points = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[chunk.data])))
    # Lines with a word, by the line that a word starts in.
    breaks = np.flatnonzero(chunk.data == 10)
    line_starts = np.union1d(chunk.bounds[:-1], breaks + 1)
    line_starts = line_starts[line_starts < len(chunk.data)]
    with_word = np.unique(np.searchsorted(line_starts, starts, side="right") - 1) if len(starts) else np.zeros(0, np.int64)
    line_from = line_starts[with_word]
    stops = np.concatenate((breaks, chunk.bounds[1:]))
    stops.sort()
    line_to = stops[np.searchsorted(stops, line_from, side="right")] if len(line_from) else line_from
    line_doc = np.searchsorted(chunk.bounds, line_from, side="right") - 1
    dup = repeated_lines(chunk.data, line_from, line_to, line_doc, names.of(line_from, line_to))
    # Windows of three words found twice or more in a text.
    window = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        whole = doc[2:] == doc[:-2]
        tri = hashes[:-2] * T.MULTIPLIERS[0] + hashes[1:-1] * T.MULTIPLIERS[1] + hashes[2:] * T.MULTIPLIERS[2]
        at = np.flatnonzero(whole)
        key = T.mix(T.mix(tri[at]) ^ T.mix(doc[at].astype(np.uint64)))
        by = np.argsort(key)
        k = key[by]
        twice = np.zeros(len(k), dtype=bool)
        same = k[1:] == k[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[by[twice]]
        for j in range(3):
            window[hit + j] = True
    suffix, lcp = suffix_lcp(hashes, doc)
    covered, longest = repeated_spans(suffix, lcp, len(hashes), least)
    longest_of = np.zeros(docs, dtype=np.int64)
    np.maximum.at(longest_of, doc, longest)
    return {
        "n_words": n_words,
        "word_chars": _per_doc(points[ends] - points[starts], first),
        "n_symbols": np.diff(symbols[chunk.bounds]),
        "n_dup_lines": np.bincount(line_doc[dup], minlength=docs),
        "n_repeat_words": _per_doc(window, first),
        "n_covered_words": _per_doc(covered, first),
        "longest_repeat": longest_of,
    }


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def quality_stats(docs: DataFrame, least: int = MIN_REPEAT) -> DataFrame:
    """doc_id and STATS for each row of docs (doc_id, text; more columns are ignored)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunk_stats(c, least) for c in T.chunks(batch.column("text"))]
            columns = [pa.array(np.concatenate([p[s] for p in parts]).astype(np.int64)) if parts else pa.array([], pa.int64()) for s in STATS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *STATS])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def judge_quality(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    least: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """STATS of each row, base_failed, and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent % of words in repeated 3-word windows.
    kept: not base_failed, at most max_covered of the words lie in repeats of at least `least` words (all maximal
    repeated substrings of the text's suffix array, spans united), and no repeat is longer than max_repeat words.
    Null, empty and wordless texts count as 0 words, so they fail. Rows are judged one by one: repeated rows and
    ids don't matter, an empty table gives no rows.
    """
    stats = quality_stats(docs, least)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    fine = (F.col("n_covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for c in T.chunks(batch.column(text_at)):
                s = chunk_stats(c, MIN_REPEAT)
                good = (s["n_words"] >= 50) & (100 * s["n_repeat_words"] <= 50 * s["n_words"])
                mask.append(good & (s["n_covered_words"] <= MAX_COVERED * s["n_words"]) & (s["longest_repeat"] <= MAX_REPEAT))
            yield batch.filter(pa.array(np.concatenate(mask) if mask else np.zeros(0, bool)))

    text_at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
