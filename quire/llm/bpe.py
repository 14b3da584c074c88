"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

A merge at a place depends on what follows only through merges of lower rank that could take its right
part first, and those in turn through still lower ones: ranks fall along the chain, so its bytes are
bounded. `lookahead` computes such a bound from the merge list alone. The transducer holds a window of a
word: tokens that end at least that far before the window's end are stable; they are emitted and their
bytes dropped, so memory does not grow with the word. Words (the tokenizer's pattern splits the text) are
independent; a bounded dictionary remembers the ids of short ones.

Decoding feeds each token's bytes through an incremental byte-to-text state machine, which holds at most
an unfinished character; malformed bytes become U+FFFD.

Defined cases: a null text is an empty one, with no tokens; a text of any length, one word or many, is
encoded whole; repeated rows repeat; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BATCH_ROWS, short_batches, sound, written

CACHE_WORDS = 300_000
#: Words up to this length are remembered, in characters.
CACHE_CHARS = 40
#: The byte-level split pattern of the vocabulary file (fixed value, published with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the
    other bytes, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A merge list over token ids, with the lookahead that suffices for it."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        if spec.get("normalizer") or spec["model"].get("end_of_word_suffix") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only added tokens that take nothing but themselves")
        self.bytes_of = {i: bytes(letters[c] for c in word) for word, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after a token's end that can decide whether it stays as it is.

        In rank order: a merge (s, w) reaches over w, and then as far as the merges of lower rank that could
        take w, or a part of w at its right edge, from the left.
        """
        reach: dict[int, int] = {}  # by token: the furthest of the merges so far with this left part
        right: dict[int, int] = {}  # a token's right part
        furthest = 1
        for (s, w), (_, made) in self.merge.items():  # in rank order
            more, edge = 0, w
            while edge is not None:
                more = max(more, reach.get(edge, 0))
                edge = right.get(edge)
            far = len(self.bytes_of[w]) + more
            furthest = max(furthest, far)
            reach[s] = max(reach.get(s, 0), far)
            right.setdefault(made, w)
        return furthest

    def merged(self, word: bytes) -> list[int]:
        """All merges of one window, lowest rank first, leftmost first."""
        ids, merge = [self.byte_id[b] for b in word], self.merge
        while len(ids) > 1:
            best, pair = None, None
            for p in zip(ids, ids[1:]):
                m = merge.get(p)
                if m is not None and (best is None or m < best):
                    best, pair = m, p
            if best is None:
                break
            a, b, made = pair[0], pair[1], best[1]
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and ids[i] == a and ids[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def transduce(self, word: bytes, window: int | None = None) -> Iterator[int]:
        """Ids of one word in order, holding no more than a window of its bytes."""
        window = max(window or 0, 2 * self.lookahead + 64)
        at = 0
        while len(word) - at > window:
            ids, end = self.merged(word[at : at + window]), 0
            for i in ids:
                if end + len(self.bytes_of[i]) > window - self.lookahead:
                    break
                end += len(self.bytes_of[i])
                yield i
            if not end:
                window *= 2
            at += end
        yield from self.merged(word[at:])


class Encoder:
    def __init__(self, tokenizer_json: str, most: int = CACHE_WORDS):
        import regex

        self.merges, self.known, self.most = Merges(tokenizer_json), {}, most
        self.words = regex.compile(PATTERN).findall
        special = sorted(self.merges.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _new(self, word: str) -> bytes:
        ids = list(self.merges.transduce(word.encode()))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = out
        return out

    def pieces(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, word by word."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.merges.special) else [text]
        known, new = self.known.get, self._new
        for part in parts:
            if part in self.merges.special:
                yield struct.pack("<I", self.merges.special[part])
            else:
                for word in self.words(part):
                    yield known(word) or new(word)

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def decode(self, ids: bytes, chunk: int = 4096) -> Iterator[str]:
        """Text of the ids, a chunk of tokens at a time."""
        state, of = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.bytes_of
        for low in range(0, len(ids), 4 * chunk):
            part = ids[low : low + 4 * chunk]
            yield state.decode(b"".join(map(of.__getitem__, struct.unpack(f"<{len(part) // 4}I", part))))
        yield state.decode(b"", True)


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One for each worker process and vocabulary."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _mapped(docs: DataFrame, tokenizer_path: str, row, schema: str) -> DataFrame:
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    kinds = {f.name: {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in spark.createDataFrame([], schema).schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary.value)
        try:
            # A few rows at a time, whatever the session's batches hold.
            for batch in (b.slice(low, BATCH_ROWS) for b in batches for low in range(0, b.num_rows, BATCH_ROWS)):
                rows = [row(coder, t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([r[k] for r in rows], kinds[n]) for k, n in enumerate(fields[1:]))], names=fields
                )
                del batch, rows
        finally:  # a worker that waits for its next task keeps the merges only
            coder.known.clear()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), sound("text").alias("text")).mapInArrow(run, schema)


def _coded(coder: Encoder, text: str) -> tuple[int, str, str]:
    ids, back = coder.encode(text), hashlib.sha256()
    for part in coder.decode(ids):
        back.update(part.encode())
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""
    return _mapped(docs, tokenizer_path, lambda coder, t: (coder.encode(t),), "doc_id long, ids binary")


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Written: doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded back. Batches are made
    where a plan runs, so it runs here, under short ones; the digests are small."""
    with short_batches(docs.sparkSession):
        return written(_mapped(docs, tokenizer_path, _coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), "bpe-digests")
