"""N-gram Jaccard join by PartEnum signatures.

Sets of word n-grams with Jaccard similarity of at least num/den share a signature for certain:
sets fall into size bands; within a band's reach two similar sets differ in at most k features, so when
the hashed feature domain is cut into n1 parts of n2 pieces each, some part differs in at most k2
pieces, and one of the enumerated subsets of n2 - k2 pieces of it is equal in both sets. n2 = 2 and k2 = 1 give the fewest
signatures a set, about k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import Workspace, maybe_broadcast, small_batches
from engram.operators.components import connected_components

#: Bounds of the 64-bit words in a parity sketch: about as many bits as the set has features.
LEAST_LONGS, MOST_LONGS = 8, 4096
#: The sketch folded to LEAST_LONGS words, as columns: most pairs are ruled out by these alone.
SHORT = [f"p{i}" for i in range(LEAST_LONGS)]
#: Bits of the index of the table that says which features are rare.
RARITY_BITS = 20


class PartEnum:
    """Signature scheme for Jaccard >= num/den. width: a band's largest size over its smallest, (den/num)**2 if not given."""

    def __init__(self, num: int = 9, den: int = 10, k2: int = 1, n2: int = 2, width: float | None = None):
        if not 0 < num < den or not 0 <= k2 < n2:
            raise ValueError("need 0 < num < den and 0 <= k2 < n2")
        self.num, self.den, self.k2, self.n2, self.width = num, den, k2, n2, width or (den / num) ** 2
        self.tops: list[int] = [1]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int((self.tops[-1] + 1) * self.width)))
        return int(np.searchsorted(self.tops, size))

    def bands(self, size: int) -> list[int]:
        """The bands of all sets that are at most as large as this one and may be similar to it."""
        least = -(-size * self.num // self.den)
        return list(range(self.band(max(least, 1)), self.band(size) + 1))

    @lru_cache(maxsize=4096)
    def layout(self, band: int) -> tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]:
        """n1, n2, spare parts, bits that differ at most, cell edges, chosen pieces by subset, salts."""
        # |union| - |intersection| <= (den - num) / num * |smaller set|
        k = self.tops[band] * (self.den - self.num) // self.num
        k2, n2 = (self.k2, self.n2) if k else (0, 1)
        n1 = -(-(k + 1) // (k2 + 1))
        spare = 1 if n1 >= 3 else 0
        n1 += spare
        cells = n1 * n2
        edges = np.array([(2**64 * i) // cells for i in range(1, cells)], dtype=object).astype(np.uint64) if cells > 1 else np.zeros(0, np.uint64)
        subsets = list(combinations(range(n2), n2 - k2))
        chosen = np.zeros((n2, len(subsets)), dtype=np.uint64)
        for j, s in enumerate(subsets):
            chosen[list(s), j] = 1
        names = np.arange(n1 * len(subsets), dtype=np.uint64) + np.uint64(band) * np.uint64(1 << 40)
        return n1, n2, spare, k, edges, chosen, T.mix(names * T.MULTIPLIERS[61] + T.MULTIPLIERS[60])

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """Signatures of a sorted array of distinct 64-bit features."""
        out = []
        sums = np.zeros(len(features) + 1, dtype=np.uint64)
        np.cumsum(T.mix(features + T.MULTIPLIERS[59]), out=sums[1:])
        for band in self.bands(len(features)):
            n1, n2, spare, _, edges, chosen, salts = self.layout(band)
            at = np.concatenate(([0], np.searchsorted(features, edges), [len(features)]))
            cell = (sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2)
            full = np.diff(at).astype(np.uint64).reshape(n1, n2) @ chosen > 0
            found = T.mix((cell @ chosen).ravel() ^ salts)
            # With `spare` more parts than needed, spare + 1 parts agree; so the subsets without any feature
            # are only needed if more than `spare` parts have one.
            if (~full.all(axis=1)).sum() <= spare:
                found = found[full.ravel()]
            out.append(found)
        return np.concatenate(out)


def _sets(batch: pa.RecordBatch, n: int, lower: bool, families: tuple[int, ...] = (0,)) -> Iterator[tuple[np.ndarray, ...]]:
    """The distinct features (hashed shingles, sorted) of each text, in each of the hash families."""
    for chunk in T.chunks(batch.column("text")):
        starts, ends, first = chunk.words(T.NOT_SPACE)
        hashes = [chunk.hashes(starts, ends, T.FOLDED if lower else T.EXACT, f) for f in families]
        for i in range(len(chunk)):
            yield tuple(np.unique(T.shingles(h[first[i] : first[i + 1]], n)) for h in hashes)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Bit i tells if an odd number of features fall into cell i. Two sketches differ in at most as many bits as their sets in
    features; the number of words is a power of two that grows with the set, and a sketch folds into a shorter one by XOR."""
    longs = LEAST_LONGS
    while longs < MOST_LONGS and longs * 64 < len(s):
        longs *= 2
    odd = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def shingle_sketches(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (h1 and h2, by independent hash families), and its parity sketch, folded and whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sketches = np.zeros((3 + LEAST_LONGS, batch.num_rows), dtype=np.uint64), []
            for i, (s, other) in enumerate(_sets(batch, n, lower, (0, 1))):
                rows[:3, i] = len(s), T.mix(s).sum(dtype=np.uint64), T.mix(other).sum(dtype=np.uint64)
                sketches.append(parity_sketch(s))
                rows[3:, i] = np.bitwise_xor.reduce(sketches[-1].reshape(-1, LEAST_LONGS), axis=0)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sketches]))).astype(np.int32))
            sketch = pa.ListArray.from_arrays(offsets, pa.array(_signed(np.concatenate(sketches)) if sketches else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(_signed(r)) for r in rows), sketch],
                ["doc_id", "n_shingles", "h1", "h2", *SHORT, "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{p} long" for p in SHORT) + ", sketch array<long>")


def shingle_signatures(docs: DataFrame, n: int, lower: bool, scheme: PartEnum) -> DataFrame:
    """sig and doc_id: a row for each PartEnum signature of each document's set; documents without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scheme.signatures(s) if len(s) else s for (s,) in _sets(batch, n, lower)]
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.concatenate(found))), pa.array(ids)] if found else [pa.array([], pa.int64())] * 2,
                ["sig", "doc_id"],
            )

    return docs.mapInArrow(run, "sig long, doc_id long")


def _cells(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def feature_counts(docs: DataFrame, n: int, lower: bool) -> np.ndarray:
    """How many features of docs fall into each of 2**RARITY_BITS cells: counted per task, then summed. Its size doesn't grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for batch in batches:
            for (s,) in _sets(batch, n, lower):
                np.add.at(total, _cells(s), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "count"])

    table = docs.mapInArrow(run, "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    counts[table.column("cell").to_numpy()] = table.column("count").to_numpy()
    return counts


def rarest_features(docs: DataFrame, n: int, lower: bool, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """sig and doc_id: of each set of m features the m - ceil(m * num / den) + 1 rarest by `counts`, ties by value. Under one order of all
    features, whatever it is, two sets of Jaccard num/den or more share one of these: sets differ in fewer features than are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[np.argsort(counts[_cells(s)], kind="stable")[: len(s) + (-len(s) * num // den) + 1]] for (s,) in _sets(batch, n, lower)]
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.concatenate(found))), pa.array(ids)] if found else [pa.array([], pa.int64())] * 2,
                ["sig", "doc_id"],
            )

    return docs.mapInArrow(run, "sig long, doc_id long")


def shingle_sets(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """doc_id and its set in the second hash family. Signatures and sketches are made of the first one, so a link needs that its
    texts agree in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for (s,) in _sets(batch, n, lower, (1,))]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            values = pa.array(_signed(np.concatenate(sets))) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def ngram_jaccard_groups(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, lower: bool = True, scheme: PartEnum | None = None) -> DataFrame:
    """Exact groups of documents connected by links of Jaccard >= num/den between their word n-gram sets.

    docs: doc_id, text (more columns are ignored). Returns doc_id, n_shingles, component_id (the smallest
    doc_id reachable), one row per row of docs. Null and empty texts, and texts without words, have an
    empty set and are linked with nothing; a text of fewer than n words has its whole sequence as the one
    shingle. Rows of one doc_id are taken as one node. A null doc_id is linked with nothing (null component).

    Flow: equal sets collapse to one representative by their digest. Representatives meet in signature buckets. Of each signature
    only the smallest and the largest document are gathered first (pre-aggregated, so a signature of any number of rows isn't
    brought together); the rows of signatures that are shared join their bucket's smallest document, in a join that Spark splits
    where it is skewed. Documents of buckets that still hold several components then meet once more, by parts of one feature each,
    the rarest ones first: what many texts share brings none of them together there. Only documents of different components are
    paired, and a large component isn't compared within itself. Pairs are pruned by size and parity sketch, which never lose a link, and confirmed on the sets, in a second hash family.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scheme = scheme or PartEnum(num, den)
    work, number = Workspace(spark, "ngram_join"), count()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    sketch = work.write(shingle_sketches(docs, n, lower), "sketch")
    n_docs = sketch.count()
    filled = sketch.filter("n_shingles > 0 and doc_id is not null")
    # Minima are written before they are joined back, so that Spark can split a key with very many rows in that join.
    reps = work.write(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "reps", n_docs)
    member = work.write(filled.select("doc_id", "h1", "h2").join(reps, ["h1", "h2"]).select("doc_id", "rep"), "member", n_docs)
    copies = member.filter("doc_id != rep").select("doc_id").distinct()
    first = member.filter("doc_id = rep").select("doc_id").distinct()
    nodes = work.write(
        filled.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", *SHORT, "sketch"),
        "nodes",
        4 * n_docs,
    )
    work.drop("reps")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs a, b (each once) that are links."""
        a, b = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "n_shingles", *SHORT, "sketch")]) for side in "ab")
        joined = pairs.join(a, F.col("a") == F.col("a_doc_id")).join(b, F.col("b") == F.col("b_doc_id"))
        pairs = work.write(joined.filter(_may_link("a_", "b_", num, den)).select("a", "b", "a_n_shingles", "b_n_shingles"), f"{name}_pairs", n_docs)
        needed = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("doc_id"))
        sets = work.write(shingle_sets(docs.join(maybe_broadcast(needed), "doc_id", "left_semi"), n, lower).dropDuplicates(["doc_id"]), f"{name}_sets")
        with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        total = F.col("a_n_shingles") + F.col("b_n_shingles")
        found = work.write(both.filter(common * (num + den) >= total * num).select("a", "b"), name, n_docs)
        work.drop(f"{name}_sets")
        work.release()
        return found

    def components(links: DataFrame, name: str) -> DataFrame:
        return connected_components(
            links.select(F.col("a").alias("src"), F.col("b").alias("dst")),
            work.write,
            name=name,
        ).select(F.col("node").alias("doc_id"), "component")

    def several(rows: DataFrame, label: DataFrame) -> DataFrame:
        """sig, doc_id, component: the rows (sig, doc_id) of buckets that hold several components."""
        labelled = rows.join(maybe_broadcast(label), "doc_id", "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        ends = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("sig")
        return labelled.join(work.write(ends, f"mixed{next(number)}", 4 * n_docs), "sig")

    named = docs.filter("doc_id is not null").join(maybe_broadcast(copies), "doc_id", "left_anti")
    sigs = shingle_signatures(named, n, lower, scheme)
    pivots = work.write(sigs.groupBy("sig").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_top")).filter("a < _top").select("sig", "a"), "pivots")
    work.release()
    buckets = work.write(sigs.join(maybe_broadcast(pivots), "sig").select("sig", "doc_id", "a"), "buckets")
    work.release()
    links = linked(buckets.filter("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), "star_links")
    label = work.write(components(links, "star_groups"), "stars", n_docs)
    open_ = work.write(several(buckets.select("sig", "doc_id"), label).select("doc_id").distinct(), "open", n_docs)
    work.drop("buckets")
    again = docs.join(maybe_broadcast(open_), "doc_id", "left_semi")
    rare = rarest_features(again, n, lower, num, den, feature_counts(again, n, lower))
    known = nodes.select("doc_id", "n_shingles", *SHORT).join(open_, "doc_id", "left_semi")
    rare = work.write(several(rare, label).join(maybe_broadcast(known), "doc_id"), "rare")
    a, b = (rare.select("sig", *[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "component", "n_shingles", *SHORT)]) for side in "ab")
    cross = a.join(b, "sig").filter(
        (F.col("a_doc_id") < F.col("b_doc_id")) & (F.col("a_component") != F.col("b_component")) & _near_in_short("a_", "b_", num, den),
    )
    more = linked(cross.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct(), "cross_links")
    joined = more.unionByName(label.filter("doc_id != component").select(F.col("component").alias("a"), F.col("doc_id").alias("b")))
    label = work.write(components(joined, "all_groups"), "groups", n_docs)
    work.keep_only("sketch", "member", "groups")

    by_rep = member.distinct().join(
        label.select(F.col("doc_id").alias("node"), "component"),
        member.rep == F.col("node"),
        "left",
    ).select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return sketch.select("doc_id", "n_shingles").join(by_rep, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _near_in_short(a: str, b: str, num: int, den: int) -> Column:
    """False only for pairs whose sizes or folded sketches rule out Jaccard >= num/den."""
    na, nb = F.col(a + "n_shingles"), F.col(b + "n_shingles")
    bits = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in SHORT), F.lit(0))
    sized = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return sized & (bits * (num + den) <= (na + nb) * (den - num))


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """False only for pairs whose sizes or whole sketches rule out Jaccard >= num/den."""
    pa_, pb = F.col(a + "sketch"), F.col(b + "sketch")
    words = F.least(F.size(pa_), F.size(pb))

    def folded(p: Column) -> Column:
        return F.when(F.size(p) == words, p).otherwise(
            F.transform(
                F.sequence(F.lit(0), words - 1),
                lambda i: F.aggregate(
                    F.sequence(F.lit(0), (F.size(p) / words).cast("int") - 1),
                    F.lit(0).cast("long"),
                    lambda x, j: x.bitwiseXOR(F.get(p, i + j * words)),
                ),
            )
        )

    bits = F.aggregate(F.zip_with(folded(pa_), folded(pb), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = (F.col(a + "n_shingles") + F.col(b + "n_shingles")) * (den - num)
    return _near_in_short(a, b, num, den) & F.when(words > LEAST_LONGS, bits * (num + den) <= most).otherwise(F.lit(True))


def keep_one_per_group(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs without near duplicates, with all their columns: of each group (see ngram_jaccard_groups) the row with the smallest
    doc_id stays; rows of equal doc_id and of null ids stay together. Null and empty texts are no one's duplicate, so they
    stay. An empty table gives no rows; columns of any name pass through."""
    groups = ngram_jaccard_groups(docs, n, num, den)
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    gone = Workspace(docs.sparkSession, "near_duplicates").write(gone, "gone")
    return docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
