"""Training-order materialisation: packed token sequences in a keyed pseudo-random order, in fixed-stride shards."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import _text as T
from engram.llm._spark import Workspace, rank_in_groups, ranges_for, small_batches

#: Split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Layout:
    """sequence: tokens per sequence; a record is that many ids of `width` bytes, little-endian."""

    sequence: int = 1024
    per_shard: int = 8192
    key: int = 2024
    end_id: int = 50256
    pad_id: int = 50256
    width: int = 2

    @property
    def stride(self) -> int:
        return self.sequence * self.width

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


class Feistel:
    """A keyed permutation of 0..n-1: four Feistel rounds over the next even number of bits; results outside are permuted
    again until they fall inside (cycle-walking), which keeps it a bijection."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = T.mix(np.arange(1, 9, dtype=np.uint64) * T.BASE + np.uint64(key % 2**64))[:4]
        self.mask = np.uint64((1 << self.half) - 1)

    def _rounds(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (T.mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (T.mix(right + k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._rounds(np.asarray(x, dtype=np.uint64), keys, back)
        while (far := out >= self.n).any():
            out[far] = self._rounds(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, back=False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, back=True)


class Tokenizer:
    """Ids of texts under a byte-level BPE vocabulary of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_stream(docs: DataFrame, path: str, layout: Layout) -> DataFrame:
    """docs (id, tie, text): id, tie, n and ids (compressed) of each text, with the end id behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = Tokenizer(path).encode, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column("text"):
                ids = encode(text.as_py()) if text.is_valid else []
                ids.append(layout.end_id)
                sizes.append(len(ids))
                packed.append(pack(np.array(ids, dtype=layout.dtype).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tie"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                ["id", "tie", "n", "ids"],
            )

    return docs.mapInArrow(run, "id long, tie long, n long, ids binary")


def packed_pieces(stream: DataFrame, layout: Layout, n: int, slots: tuple[int, int]) -> DataFrame:
    """stream (at: tokens before it; n, ids): slot, place and ids (bytes) of the pieces of sequences that each row has
    and whose slot lies in the range `slots`."""
    L, width = layout.sequence, layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, unpack = Feistel(n, layout.key), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            first = at // L
            counts = -(-(at + size) // L) - first
            row = np.repeat(np.arange(len(at)), counts)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
            slot = order.slots(seq)
            mine = (slot >= slots[0]) & (slot < slots[1])
            row, seq, slot = row[mine], seq[mine], slot[mine]
            low = np.maximum(seq * L, at[row])
            high = np.minimum((seq + 1) * L, at[row] + size[row])
            column, raw, ids, last = batch.column("ids"), b"", [], -1
            for r, a, b in zip(row.tolist(), ((low - at[row]) * width).tolist(), ((high - at[row]) * width).tolist(), strict=True):
                if r != last:
                    raw, last = unpack(column[r].as_py()), r
                ids.append(raw[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((low - seq * L).astype(np.int32)), pa.array(ids, pa.binary())], ["slot", "place", "ids"])

    return stream.select("at", "n", "ids").mapInArrow(run, "slot long, place int, ids binary")


def _open_output(uri: str):
    """write(name, chunks), which is atomic, for a local path, file: or any store that Arrow knows."""
    local = re.sub(r"^file:(//)?(?=/)", "", uri)
    if local.startswith("/"):

        def write(name: str, parts: Iterator[bytes]) -> None:
            os.makedirs(local, exist_ok=True)
            temp = f"{local}/.{name}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
            with open(temp, "wb") as f:
                f.writelines(parts)
            os.replace(temp, f"{local}/{name}")

        return write
    from pyarrow.fs import FileSystem

    store, root = FileSystem.from_uri(uri)

    def put(name: str, parts: Iterator[bytes]) -> None:
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            for p in parts:
                f.write(p)

    return put


#: Columns of what write_shards returns.
WRITTEN = "slot long, shard int, place_in_shard int, n_tokens int, tokens_sha256 string"


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def write_shards(pieces: DataFrame, out: str, layout: Layout, first: int, last: int) -> DataFrame:
    """Writes the shard files first..last-1 when it is run, and returns slot, shard, place_in_shard, n_tokens (without padding) and
    tokens_sha256 (of the record's ids without padding). A shard is written by one task, whole, and put in place at once; a
    task that is run again writes the same bytes."""
    keyed = pieces.withColumn("shard", F.expr(f"cast(slot div {layout.per_shard} as int)"))
    placed = keyed.repartitionById(last - first, F.col("shard") - first).sortWithinPartitions("shard", "slot", "place")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        slot, shard, parts = None, None, []
        for batch in batches:
            for s, k, ids in zip(batch.column("slot").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != slot:
                    if slot is not None:
                        yield shard, slot, b"".join(parts)
                    slot, shard, parts = s, k, []
                parts.append(ids)
        if slot is not None:
            yield shard, slot, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, rows = _open_output(out), []
        pad = np.array([layout.pad_id], dtype=layout.dtype).tobytes()
        source = records(batches)
        ahead = next(source, None)
        while ahead is not None:
            shard = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:  # noqa: B023
                    _, slot, ids = ahead
                    rows.append((slot, shard, slot % layout.per_shard, len(ids) // layout.width, hashlib.sha256(ids).hexdigest()))  # noqa: B023
                    yield ids + pad * (layout.sequence - len(ids) // layout.width)
                    ahead = next(source, None)

            write(shard_name(shard), own())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t) for c,
                    t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)
                ],
                ["slot", "shard", "place_in_shard", "n_tokens", "tokens_sha256"]
            )
            rows.clear()

    return placed.mapInArrow(run, WRITTEN)


def materialise_training_order(docs: DataFrame, tokenizer_path: str, out: str | None = None, layout: Layout | None = None, waves: int = 4) -> DataFrame:
    """Tokenises docs (doc_id, text; more columns are ignored), packs all texts, each followed by the end id, into
    sequences of layout.sequence tokens, gives each sequence a global slot by a keyed permutation, and writes the slots in order into
    shard files of layout.per_shard fixed-stride records; only the very last sequence is padded.

    Texts are packed in the order of a keyed hash of doc_id, then doc_id, then a hash of the text: the same rows give the same
    shards, however the table is cut into files. Null and empty texts give just the end id; an empty table gives no shards. Repeated rows
    stay (it doesn't matter which of equal ones comes first); rows of null doc_id are ordered by their texts; a long text goes over many
    sequences. Returns one row per slot (see write_shards); out (default: a folder in the shared one) also gets
    manifest.json. The compressed ids are brought into order once; then `waves` ranges of shards are made one
    after the other, so that only a part of all ids is in exchange at a time. A job that runs again writes the same bytes.
    """
    spark = docs.sparkSession
    layout = layout or Layout()
    small_batches(spark)
    work = Workspace(spark, "training_order")
    out = out or f"{work.root}/shards"
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
        F.col("text").cast("string").alias("text"),
    )
    tokens = work.write(token_stream(keyed, tokenizer_path, layout), "tokens")
    total, rows = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    order = F.xxhash64(F.lit(layout.key), "id")
    ordered = rank_in_groups(tokens, [], order, [F.col("id"), F.col("tie")], "at", F.col("n"), buckets=ranges_for(rows), groups=1)
    stream = work.write(ordered.select("at", "n", "ids"), "ordered")
    work.drop("tokens")
    work.release()
    n = -(-total // layout.sequence)
    shards = -(-n // layout.per_shard)
    manifest = asdict(layout) | {"sequences": n, "tokens": total, "shards": shards, "stride": layout.stride}
    _open_output(out)("manifest.json", iter([json.dumps(manifest, indent=1).encode()]))
    done = spark.createDataFrame([], WRITTEN)
    step = -(-shards // waves) if shards else 1
    for first in range(0, shards, step):
        last = min(first + step, shards)
        pieces = packed_pieces(stream, layout, n, (first * layout.per_shard, last * layout.per_shard))
        done = done.union(work.write(write_shards(pieces, out, layout, first, last), f"rows{first}"))
        del pieces
        work.release()  # what the wave has shuffled may go
    return done


def read_slots(out: str, first: int, count: int) -> np.ndarray:
    """Records of slots first..first+count-1 from a local folder: what a job that resumes at a slot reads, by seeking."""
    folder = re.sub(r"^file:(//)?(?=/)", "", out)
    with open(f"{folder}/manifest.json") as f:
        m = json.load(f)
    rows = []
    for slot in range(first, min(first + count, m["sequences"])):
        with open(f"{folder}/{shard_name(slot // m['per_shard'])}", "rb") as f:
            f.seek(slot % m["per_shard"] * m["stride"])
            rows.append(np.frombuffer(f.read(m["stride"]), dtype=f"<u{m['width']}"))
    return np.array(rows)
