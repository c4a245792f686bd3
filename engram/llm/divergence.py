"""Source divergence audit: how far the sources of a language use its terms differently, by sorted streams of term runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import Workspace, maybe_broadcast, small_batches

#: [^\x00-\x40\x5B-\x60\x7B-\x7F]: A-Z, a-z and all bytes of other characters.
TERM = np.zeros(256, dtype=bool)
TERM[0x80:] = True
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: What probabilities are counted in, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2
#: Runs that a task holds to add up those of its batches before they are exchanged.
HELD_RUNS = 1 << 18


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the row before it, in a sorted batch."""
    n = len(columns[0])
    differs = np.zeros(n, dtype=bool)
    if n:
        differs[0] = True
        for c in columns:
            differs[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return differs


def _added_up(held: list[pa.RecordBatch]) -> pa.Table:
    """The runs of several batches, those of equal lang, term and source as one."""
    sums = pa.Table.from_batches(held).group_by(["lang", "term", "source"]).aggregate([("document", "min"), ("df", "sum"), ("n", "sum")])
    return sums.rename_columns(["lang", "term", "source", "document", "df", "n"])


def document_runs(docs: DataFrame) -> DataFrame:
    """docs (document, lang, source, text): lang, term, source, document, df and n. A task sorts the terms of a batch of documents by
    (lang, term, source, document) and scans the runs: a row says in how many of the documents of that source that the task has seen a term stands (df), how often
    (n), and names the first of these documents. Runs of up to HELD_RUNS are held and added up. A document lies in one batch, so documents of different rows are different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in runs_of(batches):
            held.append(part)
            size += part.num_rows
            if size > HELD_RUNS:
                table = _added_up(held)
                held, size = table.to_batches(), table.num_rows
                if size > HELD_RUNS // 2:
                    yield from table.to_batches(max_chunksize=50_000)
                    held, size = [], 0
        if held:
            yield from _added_up(held).to_batches(max_chunksize=50_000)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            numbers = batch.column("document").to_numpy(zero_copy_only=False)
            for chunk in T.chunks(batch.column("text"), 4 << 20):
                starts, ends, bounds = chunk.words(TERM)
                if not len(starts):
                    continue
                letters = T.LOWER[chunk.data[TERM[chunk.data]]]  # the terms, one after the other
                sizes = ends - starts
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
                terms, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(chunk)), np.diff(bounds))
                rows = slice(chunk.first, chunk.first + len(chunk))
                lang, source = (c.indices.to_numpy()[rows][row].astype(np.int64) for c in (langs, sources))
                run_of = (lang * len(terms) + code) * len(sources.dictionary) + source
                order = np.lexsort((row, run_of))
                run_of, row = run_of[order], row[order]
                first = np.concatenate(([True], run_of[1:] != run_of[:-1]))
                other = first | np.concatenate(([True], row[1:] != row[:-1]))
                at = np.flatnonzero(first)
                head = order[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(lang[head])), terms.take(pa.array(code[head])).cast(pa.string()), sources.dictionary.take(pa.array(source[head])),
                        pa.array(numbers[rows][row[at]]), pa.array(np.add.reduceat(other.astype(np.int64), at)), pa.array(np.diff(np.append(at, len(order)))),
                    ],
                    ["lang", "term", "source", "document", "df", "n"],
                )

    return docs.mapInArrow(run, "lang string, term string, source string, document long, df long, n long")


def _whole_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of a stream that is sorted by key, in tables that don't cut a run of equal keys."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(np.flatnonzero(_changes(*[batch.column(c) for c in key]))[-1])  # where the last run begins
        if kept and not cut and all(batch.column(c)[0] == kept[-1].column(c)[-1] for c in key):
            kept.append(batch)
            continue
        if kept or cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def source_runs(parts: DataFrame) -> DataFrame:
    """parts (rows of document_runs): one row per lang, term and source, with its document frequency df and count n. The rows are exchanged by these
    three and sorted by them and the document; a scan adds up each run. Runs of a term in a hot source are as many rows as there were batches."""
    key = ["lang", "term", "source"]
    ordered = parts.repartition(*key).sortWithinPartitions(*key, "document")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: tuple | None = None  # a run may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.flatnonzero(_changes(*[batch.column(c) for c in key]))
            df, n = (np.add.reduceat(batch.column(c).to_numpy(), at) for c in ("df", "n"))
            heads = batch.select(key).take(pa.array(at))
            first, last = (tuple(heads.column(c)[i].as_py() for c in key) for i in (0, -1))
            if open_row is not None:
                if open_row[:3] == first:
                    df[0], n[0] = df[0] + open_row[3], n[0] + open_row[4]
                else:
                    yield _run_rows([[v] for v in open_row])
            if len(at) > 1:
                yield _run_rows([*heads.slice(0, len(at) - 1).columns, df[:-1], n[:-1]])
            open_row = (*last, int(df[-1]), int(n[-1]))
        if open_row is not None:
            yield _run_rows([[v] for v in open_row])

    return ordered.mapInArrow(run, "lang string, term string, source string, df long, n long")


def _run_rows(columns: list) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds, strict=True)], ["lang", "term", "source", "df", "n"])


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), exactly."""
    top = (n + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + ADDED * terms).cast("decimal(20,0)")).cast("long") + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q stay under 2^31, so that the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shared_pairs(kept: DataFrame) -> DataFrame:
    """kept (lang, term, source, p, zero: the source's probability of a term it doesn't use): lang, a, b (a < b) and extra, summed over the terms that both use:
    by how much a term's distance exceeds what it would add if each use were counted beside a zero. A scan of the sorted stream sees all sources of a term together
    and emits the partial sums of a batch."""
    ordered = kept.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["lang", "term"]):
            table = table.combine_chunks()
            lang, term, source = (table.column(c).combine_chunks() for c in ("lang", "term", "source"))
            p, zero = (table.column(c).to_numpy() for c in ("p", "zero"))
            run_no = np.cumsum(_changes(lang, term))
            langs, sources = lang.dictionary_encode(), source.dictionary_encode()
            lang_no, source_no, many = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64), len(sources.dictionary)
            pairs, sums, step = [], [], 1
            i = np.arange(len(p))
            while len(i := i[i + step < len(p)]) and len(i := i[run_no[i] == run_no[i + step]]):
                j = i + step
                pairs.append((lang_no[i] * many + source_no[i]) * many + source_no[j])
                sums.append(f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j]))
                step += 1
                if sum(map(len, pairs)) > 1 << 22:  # a term of very many sources
                    pairs, sums = ([x] for x in _summed(pairs, sums))
            if pairs:
                pair, total = _summed(pairs, sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(pair // many // many)), sources.dictionary.take(pa.array(pair // many % many)),
                        sources.dictionary.take(pa.array(pair % many)), pa.array(total),
                    ],
                    ["lang", "a", "b", "extra"],
                )

    return ordered.mapInArrow(run, "lang string, a string, b string, extra long").groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def _summed(pairs: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, total = np.concatenate(pairs), np.concatenate(sums)
    order = np.argsort(pair, kind="stable")
    pair, total = pair[order], total[order]
    at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[at], np.add.reduceat(total, at)


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """docs (lang, source, text; more columns are ignored): lang, source, part, item, value, rank. Part `pair`: every other source of the language, by how far the two
    distribute the language's kept terms differently (the sum of distance over all of them). Part `term`: the `top` terms that a source uses
    more than its language does. Kept are terms in at least least_docs rows of the language. All arithmetic is in whole numbers.

    Null text, lang and source are read as ''. Each row is a document, also where doc_ids or whole rows repeat. Sources whose texts hold no kept
    term still are groups: their probabilities are those of zero counts; in a language without kept terms all pairs have the value 0. A source alone in its language has
    no pairs. Equal values are ranked by the item's bytes. An empty table gives no rows. Long texts are read whole, one at a time; very common terms and sources are
    added up by batches of documents before they are exchanged, and by runs after it.

    The pairs of all sources of a language are the result, which is as long as that; no sum over terms is made for them: where a term is missing in a
    source its probability only depends on the source, so terms are counted by (source, count), and only terms that both sources use meet in the scan.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=4000)
    work = Workspace(spark, "divergence")
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("document"), text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    runs = work.write(source_runs(document_runs(rows)), "runs")
    in_lang = Window.partitionBy("lang", "term")
    counted = runs.select("*", F.sum("df").over(in_lang).alias("lang_df"), F.sum("n").over(in_lang).alias("lang_n"), F.min("source").over(in_lang).alias("head"))
    kept = work.write(counted.filter(F.col("lang_df") >= least_docs).select("lang", "term", "source", "n", "lang_n", (F.col("head") == F.col("source")).alias("head")), "kept")

    groups = rows.select("lang", "source").distinct()
    uses = kept.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    langs = kept.filter("head").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_used"))
    none = F.lit(0).cast("long")
    stats = groups.join(uses, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("used", "terms", "lang_used")],
    )
    stats = stats.withColumn("zero", F.when(F.col("terms") > 0, probability(none, F.col("used"), F.col("terms"))))
    stats = work.write(stats, "stats")
    used = kept.join(maybe_broadcast(stats), ["lang", "source"])
    used = used.withColumn("p", probability(F.col("n"), F.col("used"), F.col("terms")))

    mean = probability(F.col("lang_n"), F.col("lang_used"), F.col("terms"))
    over = used.withColumn("q", mean).filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = over.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    shared = shared_pairs(used)
    both = shared.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "extra").unionAll(
        shared.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "extra"),
    )
    other = stats.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    by_count = used.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("times"))
    beside = by_count.join(other, "lang").filter("source != item")
    more = F.col("times") * (distance(F.col("p"), F.col("item_zero")) - distance(F.col("zero"), F.col("item_zero")))
    beside = beside.groupBy("lang", "source", "item").agg(F.sum(more).alias("extra"))
    beside = beside.unionAll(beside.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "extra"))
    extra = both.unionAll(beside).groupBy("lang", "source", "item").agg(F.sum("extra").alias("extra"))
    pairs = stats.join(other, "lang").filter("source != item").join(extra, ["lang", "source", "item"], "left")
    empty = F.coalesce(F.col("terms") * distance(F.col("zero"), F.col("item_zero")), none)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (empty + F.coalesce("extra", none)).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    return ranked.unionByName(terms)
