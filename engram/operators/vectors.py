"""Exact vector search and similarity joins, computed block by block with matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engram.sources.scratch import scratch

#: Vectors that are compared at once.
BLOCK_ROWS = 1024
#: Measured bytes of vectors that may be sent to every executor.
SENT_BYTES = 16 << 20
#: Bands that a scope's vectors are dealt into, and bytes of a band that a task holds, beyond which there are more of them.
BANDS, HELD_BYTES = 12, 64 << 20
#: Candidates that are gathered before they are cut to the nearest.
GATHERED = 1 << 21
#: By how much the entries of a matrix product may be off, and pairs whose cosines are summed at once.
NOISE, AT_ONCE = 1e-9, 1 << 15


def _bytes(rows: DataFrame) -> int:
    width = 8 * F.coalesce(F.size("v"), F.lit(0)) + F.coalesce(F.octet_length("id"), F.lit(0)) + 64
    return rows.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def _groups(table: pa.Table | pa.RecordBatch, scope: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Scope and dimension, places and unit vectors of the rows of a table, by scope and dimension. Null, empty and zero vectors are left out."""
    v = table.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in scope), sizes.tolist(), strict=True)):
        if key[-1]:
            places.setdefault(key, []).append(i)
    for key, at in places.items():
        at = np.array(at)
        m = flat[starts[at][:, None] + np.arange(key[-1])]
        length = np.sqrt((m * m).sum(axis=1))
        at, m, length = at[length > 0], m[length > 0], length[length > 0]
        if len(at):
            yield key, at, m / length[:, None]


def _met(known: dict, fold: Callable, batch: pa.RecordBatch, scope: list[str], same: bool, block_rows: int) -> Iterator[tuple[tuple, list]]:
    """Scope and columns of what `fold` finds at once between held vectors and those of a batch. known: table, matrix and state by scope and dimension."""
    for key, at, m in _groups(batch, scope):
        if key in known:
            table, held, state = known[key]
            step = max(1, min(block_rows, (1 << 22) // len(held)))
            rows = batch.drop_columns(["v"])
            for i in range(0, len(at), step):
                if columns := fold.take(state, table, held, rows.take(pa.array(at[i : i + step])), m[i : i + step], same):
                    yield key, columns


def _known(table: pa.Table, fold: Callable, scope: list[str]) -> dict:
    slim = table.drop_columns(["v"])
    return {key: (slim.take(pa.array(at)).combine_chunks(), m, fold.start(len(m))) for key, at, m in _groups(table, scope)}


def _named(key: tuple, columns: list, kinds: pa.Schema, scope: list[str], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x] * len(columns[0]), kinds.field(c).type) for c, x in zip(scope, key, strict=False)), *columns], names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _scan(sent: DataFrame, rows: DataFrame, scope: list[str], fold: Callable, schema: str, block_rows: int) -> DataFrame:
    """Every vector of rows beside all sent ones of its scope and dimension: the sent ones go to each task, whose batches are read as they lie, so that no vector is exchanged. fold gives columns,
    after those of the scope: take() at once, rest() when a task has seen all its rows."""
    table, names = rows.sparkSession.sparkContext.broadcast(sent.toArrow()), _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds = _known(table.value, fold, scope), table.value.schema
        for batch in batches:
            for key, columns in _met(known, fold, batch, scope, True, block_rows):
                yield _named(key, columns, kinds, scope, names)
        for key, (held, _, state) in known.items():
            for columns in fold.rest(state, held):
                yield _named(key, columns, kinds, scope, names)

    return rows.mapInArrow(run, schema)


def _dealt(df: DataFrame, scope: list[str], bands: DataFrame, name: str) -> DataFrame:
    on = F.lit(True)
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = df.join(bands if scope else F.broadcast(bands), on)
    return joined.withColumn(f"_{name}", F.pmod(F.xxhash64("id"), F.col(f"_{name}s")).cast("int"))


def _bands(df: DataFrame, scope: list[str], block_rows: int, name: str) -> DataFrame:
    """Into how many bands the vectors of each scope are dealt: BANDS where there are enough of them, and only more where a band would be over HELD_BYTES."""
    size = F.sum(8 * F.coalesce(F.size("v"), F.lit(0)))
    n = F.greatest(F.least(F.lit(BANDS), F.ceil(F.count("*") / block_rows)), F.ceil(size / HELD_BYTES), F.lit(1))
    return df.groupBy(*scope).agg(n.cast("int").alias(f"_{name}s"))


def _grid(held: DataFrame, rows: DataFrame | None, scope: list[str], fold: Callable, schema: str, block_rows: int) -> DataFrame:
    """What _scan gives, without sending a side: both are dealt into bands, each pair of bands is a cell, in which a task holds one band and the other streams past it. As there are BANDS bands up
    to BANDS * HELD_BYTES of a scope, a vector is exchanged BANDS + 1 times at most, however many there are. rows: None for the held vectors among themselves, where a cell and its mirror image are one."""
    names, among = _names(schema), rows is None
    write = scratch(held.sparkSession)
    rows = held if among else rows
    bands = _bands(held, scope, block_rows, "x")
    if among:
        bands = bands.withColumn("_ys", F.col("_xs"))
    else:
        other = _bands(rows, scope, block_rows, "y")
        on = F.lit(True)
        for c in scope:
            other, on = other.withColumnRenamed(c, f"_{c}"), on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        bands = bands.join(other, on).select(*scope, "_xs", "_ys")
    bands = write(bands.select(*[F.col(c).alias(f"_{c}") for c in scope], "_xs", "_ys"), "bands")
    number = lambda a, b: F.explode(F.sequence(a, b))
    shown = [*scope, *(c for c in held.columns if c not in scope)]
    first = _dealt(held, scope, bands, "x").withColumn("_y", number(F.col("_x") if among else F.lit(0), F.col("_ys") - 1))
    second = _dealt(rows, scope, bands, "y").withColumn("_x", number(F.lit(0), F.col("_y") if among else F.col("_xs") - 1))
    for c in shown:
        if c not in rows.columns:
            second = second.withColumn(c, F.lit(None))
    cell = [*scope, "_x", "_y"]
    cells = first.select(*shown, "_x", "_y", F.lit(0).alias("_side")).unionByName(second.select(*shown, "_x", "_y", F.lit(1).alias("_side")))
    cells = cells.repartition(*cell).sortWithinPartitions(*cell, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, known, kinds = None, [], None, None

        def ends() -> Iterator[pa.RecordBatch]:
            for key, (table, _, state) in (known or {}).items():
                for columns in fold.rest(state, table):
                    yield _named(key, columns, kinds, scope, names)

        for batch in batches:
            kinds = batch.schema
            marks = list(zip(*(batch.column(c).to_pylist() for c in [*cell, "_side"]), strict=True))
            starts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(marks)], strict=True):
                part, (*at, side) = batch.slice(a, b - a), marks[a]
                if at != here:
                    yield from ends()
                    here, waiting, known = at, [], None
                if side == 0:
                    waiting.append(part)
                elif waiting or known:
                    if known is None:
                        known, waiting = _known(pa.Table.from_batches(waiting), fold, scope), []
                    for key, columns in _met(known, fold, part, scope, among and at[-1] == at[-2], block_rows):
                        yield _named(key, columns, kinds, scope, names)
        yield from ends()

    return cells.mapInArrow(run, schema)


def _column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


class Fold:
    """What is made of the vectors that meet: state of one set of held vectors, columns that are found at once, and those that are left at the end."""

    def start(self, n: int) -> object:
        return None

    def take(self, state: object, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> list | None:
        """same: both are of one set, of which each pair is met in both orders."""
        return None

    def rest(self, state: object, table: pa.Table) -> Iterator[list]:
        return iter(())


class Pairs(Fold):
    """a, b, sim of all pairs over a threshold, a before b in ord, and what columns `carry` of both hold."""

    def __init__(self, threshold: float, strict: bool, carry: tuple[str, ...] = ()):
        self.threshold, self.strict, self.carry = threshold, strict, carry

    def places(self, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
        sim = m @ held.T
        x, y = np.nonzero(sim >= self.threshold - NOISE)
        oa, ob = (_column(t, "ord").to_numpy(zero_copy_only=False) for t in (batch, table))
        ok = oa[x] < ob[y] if same else oa[x] != ob[y]
        x, y = x[ok], y[ok]
        found = self.cosines(sim, m, held, x, y)
        ok = found > self.threshold if self.strict else found >= self.threshold
        x, y = x[ok], y[ok]
        return x, y, found[ok], oa[x] > ob[y]

    def cosines(self, sim: np.ndarray, m: np.ndarray, held: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the pairs alone, summed in the same order wherever they lie, so that copies of vectors have equal cosines; the last bits of a matrix product depend on a row's place."""
        parts = [np.einsum("ij,ij->i", m[x[i : i + AT_ONCE]], held[y[i : i + AT_ONCE]]) for i in range(0, len(x), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def take(self, state: object, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> list | None:
        x, y, sim, swap = self.places(table, held, batch, m, same)
        if not len(x):
            return None
        x, y, swap = pa.array(x), pa.array(y), pa.array(swap)

        def ends(name: str) -> list:
            left, right = _column(batch, name).take(x), _column(table, name).take(y)
            return [pc.if_else(swap, right, left), pc.if_else(swap, left, right)]

        return [*ends("id"), pa.array(sim, pa.float64()), *(c for name in self.carry for c in ends(name))]


class Links(Pairs):
    """Of the pairs over a threshold, as many as connect the same vectors: one that joins two vectors which others already connect is left out."""

    def start(self, n: int) -> dict:
        return {"top": np.arange(n)}

    def cosines(self, sim: np.ndarray, m: np.ndarray, held: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sim[x, y]

    def take(self, state: dict, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> list | None:
        x, y, sim, swap = self.places(table, held, batch, m, same)
        # Of a row's pairs the first joins it to a component of held vectors, and each other one two of these components.
        top, new = state["top"], np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        first = np.repeat(y[new], np.diff(np.append(np.flatnonzero(new), len(x)))) if len(x) else y
        keep = np.flatnonzero(new)
        joins = np.flatnonzero(~new & (top[first] != top[y]))
        found, above = [], {}

        def root(c: int) -> int:
            while (d := above.get(c, c)) != c:
                above[c] = above.get(d, d)
                c = d
            return c

        for i, a, b in zip(joins.tolist(), top[first[joins]].tolist(), top[y[joins]].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
                found.append(i)
        if above:
            renamed = np.arange(len(top))
            for c in above:
                renamed[c] = root(c)
            state["top"] = renamed[top]
        at = np.sort(np.concatenate([keep, np.array(found, np.int64)]))
        if not len(at):
            return None
        left, right = _column(batch, "id").take(pa.array(x[at])), _column(table, "id").take(pa.array(y[at]))
        return [pc.if_else(pa.array(swap[at]), right, left), pc.if_else(pa.array(swap[at]), left, right), pa.array(sim[at], pa.float64())]


class Around(Fold):
    """ord of a vector and those of the ones like it (near), in lists that are given whenever GATHERED of them have been met; a vector has as many lists as it takes."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def start(self, n: int) -> dict:
        return {"keys": [], "n": 0}

    def take(self, state: dict, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> list | None:
        x, y = np.nonzero(m @ held.T >= self.threshold)
        a, b = (_column(t, "ord").to_numpy(zero_copy_only=False).astype(np.int64)[at] for t, at in ((batch, x), (table, y)))
        a, b = a[a != b], b[a != b]
        for one, other in ((a, b),) if same else ((a, b), (b, a)):
            state["keys"].append(one << 32 | other)
            state["n"] += len(one)
        return self._lists(state) if state["n"] >= GATHERED else None

    def rest(self, state: dict, table: pa.Table) -> Iterator[list]:
        if state["n"]:
            yield self._lists(state)

    def _lists(self, state: dict) -> list:
        keys = np.concatenate(state["keys"])
        state["keys"], state["n"] = [], 0
        keys.sort()
        i = keys >> 32
        new = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        near = pa.ListArray.from_arrays(pa.array(np.append(new, len(i)), pa.int32()), pa.array(keys.astype(np.int32)))
        return [pa.array(i[new]), near]


class Reach(Fold):
    """id of the vectors that a step over a threshold leads to, once for each set they are met in. from_held: the step starts from held vectors and leads to those that stream past, or the other way round.
    Vectors that aren't open only lead to ones of a later ord whose mark is what they want."""

    def __init__(self, threshold: float, from_held: bool):
        self.threshold, self.from_held = threshold, from_held

    def start(self, n: int) -> np.ndarray:
        return np.zeros(n, bool)

    def take(self, state: np.ndarray, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> list | None:
        x, y = np.nonzero(m @ held.T >= self.threshold)
        (start, f), (end, t) = ((table, y), (batch, x)) if self.from_held else ((batch, x), (table, y))
        of = lambda rows, name, at: _column(rows, name).to_numpy(zero_copy_only=False)[at]
        a, b = of(start, "ord", f), of(end, "ord", t)
        ok = (a != b) & (of(start, "open", f) | ((a < b) & (of(start, "wants", f) == of(end, "mark", t))))
        if not self.from_held:
            state[y[ok]] = True
            return None
        return [_column(batch, "id").take(pa.array(np.unique(x[ok])))] if ok.any() else None

    def rest(self, state: np.ndarray, table: pa.Table) -> Iterator[list]:
        if state.any():
            yield [_column(table, "id").take(pa.array(np.flatnonzero(state)))]


class Nearest(Fold):
    """q, id, kind, score, ord of the k nearest of each kind of all vectors that a task meets, ties to the smaller ord. Held: the queries."""

    def __init__(self, k: int):
        self.k = k

    def start(self, n: int) -> dict:
        return {"n": n, "kinds": {}}

    def take(self, state: dict, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> None:
        sim = np.maximum(held @ m.T, 0.0)
        ids, ords = _column(batch, "id"), _column(batch, "ord").to_numpy(zero_copy_only=False)
        kinds = np.array(_column(batch, "kind").to_pylist(), dtype=object)
        for kind in sorted(set(kinds)):
            mine = np.flatnonzero(kinds == kind)
            none = {"least": np.full(state["n"], -1.0), "last": np.full(state["n"], np.iinfo(np.int64).max), "parts": [], "rows": 0, "ids": pa.array([], ids.type)}
            s = state["kinds"].setdefault(kind, none)
            x, y = np.nonzero(sim[:, mine] >= s["least"][:, None])
            y = mine[y]
            score, order = sim[x, y], ords[y]
            ok = (score > s["least"][x]) | (order < s["last"][x])
            if ok.any():
                s["parts"].append((x[ok], score[ok], order[ok], y[ok] + len(s["ids"])))
                s["rows"] += int(ok.sum())
                s["ids"] = pa.concat_arrays([s["ids"], ids])
            if s["rows"] > max(GATHERED, 2 * self.k * state["n"]):
                self._cut(s)

    def _cut(self, s: dict) -> None:
        x, score, order, at = (np.concatenate(c) for c in zip(*s["parts"], strict=True))
        sorted_ = np.lexsort((order, -score, x))
        x = x[sorted_]
        new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        place = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
        sorted_, x, place = sorted_[place < self.k], x[place < self.k], place[place < self.k]
        score, order, at = score[sorted_], order[sorted_], at[sorted_]
        full = place == self.k - 1
        s["least"][x[full]], s["last"][x[full]] = score[full], order[full]
        used, at = np.unique(at, return_inverse=True)
        s["ids"] = s["ids"].take(pa.array(used))
        s["parts"], s["rows"] = [(x, score, order, at)], len(x)

    def rest(self, state: dict, table: pa.Table) -> Iterator[list]:
        for kind, s in state["kinds"].items():
            if not s["parts"]:
                continue
            self._cut(s)
            x, score, order, at = s["parts"][0]
            for i in range(0, len(x), 100_000):
                c = slice(i, i + 100_000)
                yield [_column(table, "id").take(pa.array(x[c])), s["ids"].take(pa.array(at[c])), pa.array([kind] * len(x[c]), pa.string()), pa.array(score[c]), pa.array(order[c])]


class Best(Fold):
    """q, the group and the largest cosine, of all vectors that a task meets, in column `by`. Held: the queries."""

    def __init__(self, by: str):
        self.by = by

    def start(self, n: int) -> dict:
        return {}

    def take(self, state: dict, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> None:
        groups = _column(batch, self.by).to_pylist()
        order = sorted(set(groups), key=lambda g: (g is None, g))
        place = {g: i for i, g in enumerate(order)}
        at = np.array([place[g] for g in groups])
        sorted_ = np.argsort(at, kind="stable")
        best = np.maximum.reduceat((held @ m.T)[:, sorted_], np.searchsorted(at[sorted_], np.arange(len(order))), axis=1)
        for i, g in enumerate(order):
            state[g] = np.maximum(state[g], best[:, i]) if g in state else best[:, i].copy()

    def rest(self, state: dict, table: pa.Table) -> Iterator[list]:
        for g, best in state.items():
            yield [_column(table, "id"), pa.array([g] * len(best), self.type), pa.array(best)]


class Cosines(Fold):
    """q, id, cos of all."""

    def take(self, state: object, table: pa.Table, held: np.ndarray, batch: pa.RecordBatch, m: np.ndarray, same: bool) -> list:
        x, y = (a.ravel() for a in np.indices((len(held), len(m))))
        return [_column(table, "id").take(pa.array(x)), _column(batch, "id").take(pa.array(y)), pa.array((held @ m.T)[x, y])]


def cosines(queries: DataFrame, vectors: DataFrame, scope: list[str]) -> DataFrame:
    """The cosine of each query (id, v) with each vector (id, v) of its scope and dimension: scope, q, id, cos. For few queries beside few vectors, such as the centres of cells."""
    kinds = dict(vectors.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in scope] + ["q string, id string, cos double"])
    return _scan(queries.select(*scope, "id", "v"), vectors.select(*scope, "id", "v"), scope, Cosines(), schema, BLOCK_ROWS)


def similar_pairs(vectors: DataFrame, threshold: float, strict: bool = False, scope: list[str] | None = None, block_rows: int = BLOCK_ROWS, carry: list[str] | None = None) -> DataFrame:
    """All pairs of vectors (id string, ord long, v array) within a scope whose cosine reaches the threshold (strict: exceeds it):
    scope, a, b, sim with a before b in ord. Vectors of different dimension aren't compared; null and zero vectors are like none.
    carry: columns of the vectors that come with both ends, as a_name and b_name, so that pairs needn't be joined with what is known of a vector.

    Vectors of SENT_BYTES at most, which is measured, go to every task whole and are met by the rows as they lie. Beyond that bands of them meet in cells (see _grid), so the work spreads
    evenly however large a scope is, and only the pairs found leave it.
    """
    kinds, carry = dict(vectors.dtypes), carry or []
    found = ", ".join(["a string, b string, sim double", *(f"{end}_{c} {kinds[c]}" for c in carry for end in "ab")])
    return _among(vectors, Pairs(threshold, strict, tuple(carry)), scope or [], block_rows, found, carry)


def similar_links(vectors: DataFrame, threshold: float, strict: bool = False, scope: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Enough of similar_pairs to connect the same vectors, for connected components: each task leaves out pairs that join what its others connect, so that at most about one pair for each vector of
    a cell leaves it, however many are similar."""
    return _among(vectors, Links(threshold, strict), scope or [], block_rows)


def similar_around(vectors: DataFrame, threshold: float, scope: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """similar_pairs as lists, both ways: scope, i (a vector's ord), near (ords, below 2**31, of some of those that reach the threshold with it). A pair of vectors is in one list of each of the two;
    a vector may have several lists."""
    return _among(vectors, Around(threshold), scope or [], block_rows, "i long, near array<int>")


def similar_hops(seeds: DataFrame, vectors: DataFrame, threshold: float, max_hops: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors within max_hops of the seeds (agent_id, id), with the fewest hops: agent_id, id, hops, where a hop leads from a vector (agent_id, id string, ord long, open boolean, wants long,
    mark long, v) to those of its agent whose cosine reaches the threshold; from one that isn't open only to those after it in ord whose mark is what it wants.

    It is graph.bfs_hops over similar_pairs, but no pair is a row: in each hop the vectors of the frontier meet those that weren't reached, the smaller side is sent (SENT_BYTES at most) or both meet in
    cells, and a task gives at most the vectors that are reached.
    """
    write, scope = scratch(vectors.sparkSession), ["agent_id"]
    every = vectors.filter("id is not null and ord is not null").select("agent_id", "id", F.col("ord").cast("long").alias("ord"), F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("wants", F.lit(-1)).cast("long").alias("wants"), F.coalesce("mark", F.lit(-2)).cast("long").alias("mark"), "v")
    seen = frontier = write(seeds.select("agent_id", "id").distinct().withColumn("hops", F.lit(0)), "hop0")
    for hop in range(1, max_hops + 1):
        start = write(every.join(frontier, ["agent_id", "id"], "left_semi").select(*every.columns), f"start{hop}")
        end = write(every.join(seen, ["agent_id", "id"], "left_anti").select(*every.columns), f"end{hop}")
        n_start, n_end = _bytes(start), _bytes(end)
        held, rows = (start, end) if n_start <= n_end else (end, start)
        fold, schema = Reach(threshold, n_start <= n_end), f"agent_id {dict(every.dtypes)['agent_id']}, id string"
        found = _scan(held, rows, scope, fold, schema, block_rows) if min(n_start, n_end) <= SENT_BYTES else _grid(held, rows, scope, fold, schema, block_rows)
        frontier = write(found.distinct().withColumn("hops", F.lit(hop)), f"hop{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _among(vectors: DataFrame, fold: Fold, scope: list[str], block_rows: int, found: str = "a string, b string, sim double", carry: list[str] | None = None) -> DataFrame:
    kinds = dict(vectors.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in scope] + [found])
    rows = scratch(vectors.sparkSession)(vectors.select(*scope, "id", F.col("ord").cast("long").alias("ord"), "v", *(carry or [])), "vectors")
    if _bytes(rows) <= SENT_BYTES:
        return _scan(rows, rows, scope, fold, schema, block_rows)
    return _grid(rows, None, scope, fold, schema, block_rows)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, scope: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest vectors (id string, ord long, kind string, v) of each query (id string, ord long, v) by cosine, per kind first and then over
    all: scope, q, id, kind, score (not below 0), rank (from 1). Ties: interest points first, then by ord. Vectors of another dimension than
    the query's, null and zero ones aren't found, and null and zero queries find nothing.

    Queries of SENT_BYTES at most, which is measured, go to every task that reads vectors; beyond that bands of both meet in cells (see _grid). Either way a task gives at most k rows per query and
    kind of all vectors that it has seen, before anything is shuffled.
    """
    scope = scope or []
    kinds = dict(vectors.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in scope] + ["q string, id string, kind string, score double, ord long"])
    asked = scratch(queries.sparkSession)(queries.select(*scope, "id", "v"), "queries")
    vectors = vectors.select(*scope, "id", F.col("ord").cast("long").alias("ord"), "kind", "v")
    found = _beside(asked, vectors, scope, Nearest(k), schema, block_rows)
    order = [F.col("score").desc(), F.col("ord")]
    per_kind = found.withColumn("_rk", F.row_number().over(Window.partitionBy(*scope, "q", "kind").orderBy(*order))).filter(F.col("_rk") <= k)
    total = F.row_number().over(Window.partitionBy(*scope, "q").orderBy(F.col("score").desc(), F.col("kind"), F.col("ord")))
    return per_kind.withColumn("rank", total).filter(F.col("rank") <= k).select(*scope, "q", "id", "kind", "score", "rank")


def _beside(asked: DataFrame, vectors: DataFrame, scope: list[str], fold: Fold, schema: str, block_rows: int) -> DataFrame:
    if _bytes(asked) <= SENT_BYTES:
        return _scan(asked, vectors, scope, fold, schema, block_rows)
    wide = asked.select(*asked.columns, *[F.lit(None).cast(t).alias(c) for c, t in vectors.dtypes if c not in asked.columns])
    return _grid(wide, scratch(vectors.sparkSession)(vectors, "beside"), scope, fold, schema, block_rows)


def group_affinity(queries: DataFrame, vectors: DataFrame, by: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The largest cosine of each query (id string, v) to the members of each group of vectors (id string, by, v): q, by, affinity; null where none of a group can be compared with a query: vectors of
    another dimension, null and zero ones. A task gives one row per query and group of all vectors that it has seen."""
    kind, fold = dict(vectors.dtypes)[by], Best(by)
    fold.type = to_arrow_type(vectors.schema[by].dataType)
    asked = scratch(queries.sparkSession)(queries.select("id", "v"), "queries")
    found = _beside(asked, vectors.select("id", by, "v"), [], fold, f"q string, {by} {kind}, affinity double", block_rows)
    best = found.groupBy("q", F.col(by).alias("_by")).agg(F.max("affinity").alias("affinity"))
    every = asked.select(F.col("id").alias("_q")).join(vectors.select(by).distinct(), F.lit(True))
    return every.join(best, (F.col("q") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_by")), "left").select(F.col("_q").alias("q"), by, "affinity")


def history_links(current: DataFrame, history: DataFrame, least: float, k: int = 20) -> DataFrame:
    """Each current vector with the similar ones of history: its k nearest over both kinds, of these the interest points whose cosine
    exceeds `least`: point, hist, sim. The cut to k comes before the choice of kind."""
    near = top_k(current, history, k)
    return near.filter((F.col("kind") == "interest_point") & (F.col("score") > least)).select(
        F.col("q").alias("point"),
        F.col("id").alias("hist"),
        F.col("score").alias("sim"),
    )
