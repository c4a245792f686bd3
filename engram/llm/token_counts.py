"""Token counts: pre-tokens that are proven to be one token are looked up; only the rest goes through the merges."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from engram.llm._spark import BROADCAST_BYTES, small_batches

#: Words whose counts a worker keeps, and bytes of a text that are split at once. Both bound memory only.
KEPT_WORDS, PIECE_BYTES = 1 << 18, 1 << 20
#: Parts of a vocabulary file under which a text's count is the sum of the counts of its words between ASCII white space: none of these normalisers
#: combines anything with white space, and no match of the split contains any.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Below this, letters, numbers and their lower case don't depend on the version of Unicode, and composing changes nothing.
PLAIN = "\u0250"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: The byte-level alphabet: bytes that print stand for themselves, the others for the code points from 256 on, in order.
_PRINT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}


def spell(piece: str) -> str:
    """The bytes of a string as letters of the byte-level alphabet."""
    return piece.encode().decode("latin-1").translate(ALPHABET)


def check_vocabulary(vocabulary: str) -> dict:
    """The parsed file; ValueError if it isn't one for which words between white space can be counted one by one."""
    read = json.loads(vocabulary)
    steps = read["normalizer"]["normalizers"] if read["normalizer"] and read["normalizer"]["type"] == "Sequence" else [read["normalizer"]]
    cut = (read["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    by_split = cut[0].get("type") == "Split" and cut[0]["pattern"] == {"Regex": SPLIT} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
    by_bytes = [c["type"] for c in cut[1:]] == ["ByteLevel"] and not cut[1]["use_regex"] and not cut[1]["add_prefix_space"]
    added = all(not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in read["added_tokens"])
    plain = read["model"]["type"] == "BPE" and not read["model"]["dropout"] and all(s in NORMALIZERS for s in steps)
    if not (by_split and by_bytes and added and plain):
        raise ValueError("a vocabulary whose words between white space can't be counted one by one")
    return read


def prove_whole_tokens(vocabulary: str) -> set[str]:
    """The strings of the vocabulary that, standing alone, the merges turn into one token: that very string. They are written in the letters of the
    byte-level alphabet, as pre-tokens are, and without the mark of a word's end. Many strings aren't among them: those that only occur inside of words,
    and those that other merges tear apart first."""
    from tokenizers import Tokenizer

    model, end = Tokenizer.from_str(vocabulary).model, json.loads(vocabulary)["model"].get("end_of_word_suffix") or ""
    whole = set()
    for string in json.loads(vocabulary)["model"]["vocab"]:
        alone = string.removesuffix(end)
        if string.endswith(end) and alone and [t.value for t in model.tokenize(alone)] == [string]:
            whole.add(alone)
    return whole


class WordCounts(dict):
    """word (bytes between ASCII white space): its row in `table`, which holds its tokens, pre-tokens, and those of them that went through the merges."""

    def __init__(self, vocabulary: str, whole: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        self.normalize, self.split, self.model = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        self.whole, self.merged = whole, {}
        self.ascii = re.compile(SPLIT.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")).findall
        self.findall, self.lower = regex.compile(SPLIT).findall, {"type": "Lowercase"} in json.loads(vocabulary)["normalizer"].get("normalizers", [])
        added = sorted((t["content"] for t in json.loads(vocabulary)["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.table = np.zeros((1024, 3), np.int64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[row] = self.count(word.decode("utf-8", "replace"))
        self[word] = row
        return row

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text in the byte-level alphabet. Below PLAIN the split is a regular expression, else the library's own."""
        if text.isascii() and text.isprintable():
            text = text.lower() if self.lower else text
            return [text] if text.isalpha() else self.ascii(text)
        if max(text, default="") >= PLAIN:
            return [p for p, _ in self.split(self.normalize(text))]
        return [spell(p) for p in self.findall(text.lower() if self.lower else text)]

    def merge(self, piece: str) -> int:
        """The tokens that the merges make of a pre-token."""
        if piece not in self.merged:
            if len(self.merged) > KEPT_WORDS:
                self.merged.clear()
            self.merged[piece] = len(self.model.tokenize(piece))
        return self.merged[piece]

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens and merged pre-tokens of a text without white space. Strings of added tokens are one token each, found before anything else."""
        parts = self.added.split(text) if self.added else [text]
        pieces = [p for part in parts for p in self.pieces(part)]
        rest = [p for p in pieces if p not in self.whole]
        return len(parts) - 1 + len(pieces) - len(rest) + sum(map(self.merge, rest)), len(pieces), len(rest)

    def of(self, text: bytes) -> np.ndarray:
        total = np.zeros(3, np.int64)
        for piece in _pieces(text):
            if len(self) > KEPT_WORDS:
                self.clear()
            words = piece.split()
            rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            total += self.table[rows].sum(axis=0)
        return total


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cuts a text at white space into pieces of about PIECE_BYTES."""
    white, at = re.compile(rb"[ \t\n\r\x0b\x0c]"), 0
    while len(text) - at > PIECE_BYTES:
        cut = white.search(text, at + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


@functools.lru_cache(maxsize=2)
def _word_counts(vocabulary: str, whole: frozenset[str]) -> WordCounts:
    return WordCounts(vocabulary, whole)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Of each row of docs (doc_id, text; more columns are ignored): doc_id, n_bytes (UTF-8), n_tokens, n_pretokens, n_merged (those that aren't one token by
    the proof, so that merges were applied) and over_limit (n_tokens > limit), as the library counts without begin, end or added special tokens, and with
    special strings in a text as one token each.

    Null and empty texts have no tokens. Rows are counted one by one: repeated rows and ids stay, an empty table stays empty. A long text is
    split in pieces of PIECE_BYTES, but a single word has to fit into memory. path: a vocabulary file (tokenizers, word BPE that drops white space;
    others are refused), read by the driver and sent to the executors if it has at most BROADCAST_BYTES, else refused.
    """
    spark = docs.sparkSession
    if os.path.getsize(path) > BROADCAST_BYTES:
        raise ValueError(f"a vocabulary of over {BROADCAST_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    check_vocabulary(text)
    small_batches(spark)
    sent = spark.sparkContext.broadcast((text, frozenset(prove_whole_tokens(text))))
    keyed = docs.select("doc_id", docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _word_counts(*sent.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            found = np.array([counts.of(t.as_py()) for t in texts], np.int64).reshape(-1, 3)
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, *[pa.array(found[:, i]) for i in range(3)], pa.array(found[:, 0] > limit)],
                ["doc_id", "n_bytes", "n_tokens", "n_pretokens", "n_merged", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, n_pretokens long, n_merged long, over_limit boolean")
