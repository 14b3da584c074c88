"""Token ids in directly addressable files.

A file (.dac) holds the ids of whole documents. Each id is cut into 8-bit chunks, lowest first; level k
holds the k-th chunks of the ids that have one, a bitmap says of each chunk whether the id goes on in the
next level, and a rank directory holds the ones before each 512-bit block, so any id is found by one rank
per level without decoding its neighbours.

Layout, little-endian: 4 bytes `DAC1`; int64 documents, ids, levels; int64 doc_ids; uint8 is_null; int64
starts (documents + 1); then per level int64 chunks, uint8 chunks, uint8 bitmap (bit i in byte i >> 3, padded
to whole 64-byte blocks), int64 rank directory (blocks + 1).

Defined cases: a null text is an empty one (only the end id is written); a null doc_id sorts first and is
kept as null; repeated rows are written repeatedly, side by side, in as many tasks as they fill; texts of any length are
read whole, and one longer than a file makes a longer file; bytes that are no UTF-8 count as U+FFFD; an empty table
writes no file; further columns are not read. A tokenizer that does not fold case, split at white space and mark the
ends of words is encoded text by text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import bucket_count, scratch, short_batches, sound, written

END_ID = 2
#: A file is closed after so many ids (about 8 MB); a longer document makes one longer file.
FILE_IDS = 4_000_000
#: Files that one task reads back.
FILES_A_TASK = 4
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 400_000
BLOCK_BITS = 512
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def dac_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents; ids are unsigned 32-bit, starts has one entry more than doc_ids."""
    out = [
        np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes(),
        np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(),
        np.asarray(starts, dtype="<i8").tobytes(),
    ]
    rest, levels = np.asarray(ids, dtype=np.uint32), 0
    while len(rest):
        chunks, rest = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(8)
        more = rest > 0
        blocks = -(-len(chunks) // BLOCK_BITS)
        bitmap = np.zeros(blocks * BLOCK_BITS // 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        rank = np.zeros(blocks + 1, dtype="<i8")
        np.cumsum(ONES[bitmap].reshape(blocks, -1).sum(1), out=rank[1:])
        out += [struct.pack("<q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), rank.tobytes()]
        rest, levels = rest[more], levels + 1
    return b"DAC1" + struct.pack("<3q", len(doc_ids), len(ids), levels) + b"".join(out)


class DacFile:
    """Random access to the ids of a file's bytes; nothing is copied when it is opened."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 file")
        self.documents, self.ids, levels = struct.unpack_from("<3q", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        doc_ids, nulls = take("<i8", self.documents), take("u1", self.documents)
        self.doc_ids = [None if n else int(d) for d, n in zip(doc_ids, nulls)]
        self.starts = take("<i8", self.documents + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = take("<i8", 1)
            blocks = -(-int(n) // BLOCK_BITS)
            self.levels.append((take("u1", int(n)), take("u1", blocks * BLOCK_BITS // 8), take("<i8", blocks + 1)))

    def _rank(self, level: int, at: int) -> int:
        """Ones of the level's bitmap before bit at."""
        _, bitmap, rank = self.levels[level]
        block = at // BLOCK_BITS
        ones = int(rank[block]) + int(ONES[bitmap[block * BLOCK_BITS // 8 : at >> 3]].sum())
        return ones + (int(ONES[bitmap[at >> 3] & ((1 << (at & 7)) - 1)]) if at & 7 else 0)

    def id_at(self, at: int) -> int:
        if not 0 <= at < self.ids:
            raise IndexError(at)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * level)
            if not bitmap[at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(level, at)
        return value

    def slice(self, low: int, high: int) -> np.ndarray:
        """Ids low..high-1, by one rank per level."""
        out, where = np.zeros(high - low, dtype=np.uint32), np.arange(high - low)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if low >= high:
                break
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[low >> 3 : (high + 7) >> 3], bitorder="little")[low & 7 :][: high - low].astype(bool)
            where = where[bits]
            low = self._rank(level, low)
            high = low + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


#: Punctuation that closes a word of which the last character is a letter.
CLOSED = re.compile(rb"(?<=[a-z])[.,;:!?*%$#&|]+(?=[\x20\x09-\x0D]|\Z)")


#: Samples on which a tokenizer of the word-by-word kind gives the ids of its words in a row.
SAMPLES = ["Hello, World! it's  a\tTest.\nnew line; café 42 times (x-y)", "UPPER lower MiXed\x0b...what?! no. yes: a;b", "  lead and trail  ", "don't I'll we've 3.14 #tag $5 50% a&b", "naïve ÉCOLE ß İ 東京 x\u3000y"]


def splits_words(tokenizer_json: str) -> bool:
    """Whether a tokenizer's ids are those of its words in a row: it marks word ends, folds case, drops white space,
    and its added tokens take nothing but themselves. Read off its file, then tried on SAMPLES."""
    import json

    from tokenizers import Tokenizer

    parts = json.loads(tokenizer_json)
    steps = json.dumps([parts.get("normalizer"), parts.get("pre_tokenizer")])
    if (parts.get("model") or {}).get("end_of_word_suffix") != "</w>" or "Lowercase" not in steps:
        return False
    added = parts.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"].startswith("<|") for t in added):
        return False
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    words = lambda t: CLOSED.sub(rb" \g<0>", t.encode().lower()).split()
    return all(ids(t) == [i for w in words(t) for i in ids(w.decode())] for t in SAMPLES)


class WordEncoder:
    """Ids of texts by the tokenizers library, word by word.

    White space ends every word of this tokenizer (its pattern takes none in, its normalizer does not join
    letters across it), closing punctuation after a letter is a piece of its own, and case is folded. So a
    text's ids are those of its folded words and closings in a row. Each distinct one is encoded once and kept,
    in a dictionary of bounded size. Words of letters only are one piece each, and many go to the library in
    one call: a piece's last id is one that ends a word.

    All this is read off the tokenizer's file (`by_words`); a tokenizer of another make encodes whole texts.
    """

    def __init__(self, tokenizer_json: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_str(tokenizer_json), {}, most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = splits_words(tokenizer_json)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _split(self, text: bytes) -> list[bytes]:
        """Words; a text that may hold special tokens, which are matched as written, is only cut at white space."""
        return text.split() if b"<|" in text else CLOSED.sub(rb" \g<0>", text.lower()).split()

    def _learn(self, words: Iterable[bytes]) -> None:
        letters, others = [], []
        for word in words:
            (letters if word.decode().isalpha() else others).append(word)
        for low in range(0, len(letters), 1000):
            some = letters[low : low + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(some):
                others += some
                continue
            data, at = ids.tobytes(), 0
            for word, stop in zip(some, stops.tolist()):
                self.known[word] = data[at:stop]
                at = stop
        for low in range(0, len(others), 10_000):
            some = others[low : low + 10_000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.known[word] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text in UTF-8."""
        if not self.by_words:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        split = [self._split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*split)
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_encoders: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """One for each worker process and vocabulary."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def put(folder: str, name: str, data: bytes) -> None:
    """Written under another name and moved, so that a repeated task leaves whole files only."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, end each document with end_id, write in ascending doc_id order.

    Returns a row for each file, in order: name, documents, ids, start (ids of all files before).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary.value).encode, np.array([end_id], dtype="<u4").tobytes()
        task, part = TaskContext.get().partitionId(), 0
        doc_ids, blobs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, blobs, held, part
            starts = np.zeros(len(blobs) + 1, dtype=np.int64)
            np.cumsum([len(b) // 4 for b in blobs], out=starts[1:])
            name = f"tokens-{task:08d}-{part:06d}.dac"
            put(folder, name, dac_bytes(doc_ids, starts, np.frombuffer(b"".join(blobs), dtype="<u4")))
            row = pa.RecordBatch.from_pydict({"name": [name], "documents": pa.array([len(blobs)], pa.int64()), "ids": pa.array([held], pa.int64())})
            doc_ids, blobs, held, part = [], [], 0, part + 1
            return row

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or b"" for t in texts])):
                doc_ids.append(doc_id)
                blobs.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= file_ids:
                    yield flush()
        if blobs:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), sound("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
        .repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    )
    with short_batches(spark):
        files = written(ordered.mapInArrow(write, "name string, documents long, ids long"), "token-index")
    # A running sum over the files, in two steps: inside hundreds of them, and over the hundreds.
    before = W.orderBy("hundred").rowsBetween(W.unboundedPreceding, -1)
    grouped = files.withColumn("hundred", F.substring("name", 1, len("tokens-000000")))
    wholes = grouped.groupBy("hundred").agg(F.sum("ids").alias("sum")).select("hundred", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("hundred").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return written(grouped.join(F.broadcast(wholes), "hundred").select("name", "documents", "ids", start.alias("start")), "token-starts")


def get(folder: str, name: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def read_token_files(folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' bytes: a task reads the files of its index rows."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = DacFile(get(folder, name))
                sums = [zlib.crc32(f.document(i).astype("<u4").tobytes()) for i in range(f.documents)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(f.doc_ids, pa.int64()), "start": pa.array(f.starts[:-1] + first, pa.int64()),
                    "n_tokens": pa.array(np.diff(f.starts), pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                })

    # Names only are moved: a task for each FILES_A_TASK files.
    dealt = index.select("name", "start").repartition(bucket_count(index.count(), FILES_A_TASK), "name")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files and read every document back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    index = write_token_files(docs, folder, tokenizer_path, **options)
    if not index.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(folder, index)
