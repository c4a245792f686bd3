"""What keyword search looks at, and the postings of its trigrams, which the store derives from every write."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Postings that a task gathers before it makes lists of them.
GATHERED = 4_000_000


def point_bodies(points: DataFrame) -> DataFrame:
    """agent_id, id, kind, body, importance, status of points."""
    body = F.concat_ws(" ", "name", "summary", F.to_json("keywords"))
    return points.select("agent_id", "id", F.lit("interest_point").alias("kind"), body.alias("body"), "importance", "status")


def page_bodies(pages: DataFrame) -> DataFrame:
    """agent_id, id, kind, body, updated_at, status of pages."""
    return pages.select("agent_id", "id", F.lit("wiki_page").alias("kind"), F.concat_ws(" ", "title", "body_md").alias("body"), "updated_at", "status")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a short text, such as a query, in lower case."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _lists(owners: list[tuple], whose: np.ndarray, codes: np.ndarray, rows: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """Postings (owner, code of a trigram, row) as one list of ids per owner and trigram."""
    order = np.lexsort((codes, whose))
    whose, codes, rows = whose[order], codes[order], rows[order]
    starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (whose[1:] != whose[:-1])))
    points = np.stack([codes[starts] >> 42, codes[starts] >> 21 & 0x1FFFFF, codes[starts] & 0x1FFFFF], axis=1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    ends = np.append(starts, len(codes))
    step = 20_000
    for i in range(0, len(starts), step):
        own = [owners[w] for w in whose[starts[i : i + step]].tolist()]
        n, at = len(own), ends[i : i + step + 1]
        lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), ids.take(pa.array(rows[at[0] : at[-1]])))
        grams = [text[3 * j : 3 * j + 3] for j in range(i, i + n)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.string()), pa.array(grams, pa.string()), pa.array([o[1] for o in own], pa.string()), lists], ["agent_id", "gram", "kind", "ids"])


def postings(entries: DataFrame) -> DataFrame:
    """entries (agent_id, id, kind, body): agent_id, gram, kind, ids. A task gathers GATHERED postings at a time and gives one list for each trigram of an agent among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[tuple, int] = {}
        whose, codes, rows, ids, n = [], [], [], [], 0

        def gathered() -> Iterator[pa.RecordBatch]:
            if codes:
                yield from _lists(list(owners), np.concatenate(whose), np.concatenate(codes), np.concatenate(rows), pa.array(ids, pa.string()))
            for kept in (owners, whose, codes, rows, ids):
                kept.clear()

        for batch in batches:
            for agent, kind, id_, body in zip(*(batch.column(c).to_pylist() for c in ("agent_id", "kind", "id", "body")), strict=True):
                c = np.frombuffer((body or "").encode("utf-32-le"), "<u4").astype(np.int64)
                if len(c) < 3:
                    continue
                found = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
                whose.append(np.full(len(found), owners.setdefault((agent, kind), len(owners)), np.int32))
                codes.append(found)
                rows.append(np.full(len(found), len(ids), np.int32))
                ids.append(id_)
                n += len(found)
                if n >= GATHERED:
                    yield from gathered()
                    n = 0
        yield from gathered()

    return entries.select("agent_id", "kind", "id", F.lower("body").alias("body")).mapInArrow(run, "agent_id string, gram string, kind string, ids array<string>")


def lists(index: DataFrame) -> DataFrame:
    """Rows of the postings' tables as agent_id, gram, kind, ids. Files of older versions hold single ids."""
    return index.select("agent_id", "gram", "kind", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array("id")).alias("ids"))


#: Tables whose parts have postings, which are written whenever a part is.
INDEXED = {"interest_points": ("point_postings", lambda df: postings(point_bodies(df))), "wiki_pages": ("page_postings", lambda df: postings(page_bodies(df)))}
#: The rule of a store whose postings are complete.
COMPLETE = "postings"
