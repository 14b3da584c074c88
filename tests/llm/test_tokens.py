"""Token files and byte-pair encoding, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.bpe import Encoder, encode_and_decode, encode_documents
from quire.llm.token_files import DacFile, dac_bytes, token_files

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_dac_gives_any_token():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**b, 400) for b in (4, 8, 9, 16, 17, 24, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    f = DacFile(dac_bytes([3, None, 9], np.array([0, 10, 10, len(ids)]), ids))
    assert [f.id_at(i) for i in range(len(ids))] == ids.tolist()
    for low, high in ((0, 0), (0, 1), (511, 513), (700, 2799), (0, len(ids))):
        assert f.slice(low, high).tolist() == ids[low:high].tolist()
    assert f.doc_ids == [3, None, 9] and f.document(1).tolist() == [] and f.document(0).tolist() == ids[:10].tolist()
    assert DacFile(dac_bytes([], np.array([0]), np.array([], dtype=np.uint32))).ids == 0


def check_files(docs, **options):
    tokenizer = Tokenizer.from_file(WORD)
    rows = sorted(token_files(docs, WORD, **options).collect(), key=lambda r: r["start"])
    want = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        ids = tokenizer.encode(w["text"] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (w["doc_id"], at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)


def test_token_files(odd, none, small):
    check_files(odd)
    check_files(odd, file_ids=10)
    check_files(small, file_ids=20_000)
    assert token_files(none, WORD).collect() == []


@pytest.fixture(scope="module")
def coder():
    with open(BYTE, encoding="utf-8") as f:
        return Encoder(f.read())


def test_lookahead_suffices_on_long_words(coder):
    tokenizer, rng = Tokenizer.from_file(BYTE), random.Random(4)
    tokens = [t for t in coder.merges.bytes_of.values() if t.isalpha()]
    for _ in range(40):
        word = "".join(rng.choice((rng.choice(tokens).decode(), rng.choice("abehinorst"))) for _ in range(rng.randint(200, 900)))
        assert list(coder.merges.transduce(word.encode())) == tokenizer.encode(word, add_special_tokens=False).ids
    for word in ("a" * 9000, "ab" * 4000, "=" * 5000, "0" * 3001):
        assert list(coder.merges.transduce(word.encode())) == tokenizer.encode(word, add_special_tokens=False).ids


def test_decoder_keeps_state_over_chunks(coder):
    tokenizer = Tokenizer.from_file(BYTE)
    text = "東京 😀 naïve é ‍" * 50
    for chunk in (1, 2, 7):
        assert "".join(coder.decode(coder.encode(text), chunk)) == text
    broken = [i for i, b in coder.merges.bytes_of.items() if len(b) == 1 and b[0] >= 0x80][:60]
    assert "".join(coder.decode(raw(broken), 1)) == tokenizer.decode(broken, skip_special_tokens=False)


def check_coded(docs):
    tokenizer = Tokenizer.from_file(BYTE)
    want = []
    for w in docs.collect():
        ids = tokenizer.encode(w["text"] or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((w["doc_id"], len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, encode_and_decode(docs, BYTE).collect()), key=str) == sorted(want, key=str)


def test_encode_and_decode(odd, none, small):
    check_coded(odd)
    check_coded(small)
    assert encode_and_decode(none, BYTE).collect() == []
    assert {r["doc_id"] for r in encode_documents(odd, BYTE).collect()} == {r["doc_id"] for r in odd.collect()}


def test_settings_of_the_session_stay(spark, odd):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 777)
    try:
        token_files(odd, WORD).collect()
        encode_and_decode(odd, BYTE).collect()
        assert spark.conf.get(name) == "777"
    finally:
        spark.conf.unset(name)


def test_bytes_that_are_no_text(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    bad = pa.array([b"good \xff\xfe text", b"plain text"]).cast(pa.binary())
    pq.write_table(pa.table({"doc_id": [1, 2], "text": bad}), tmp_path / "docs.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/docs.parquet").selectExpr("doc_id", "CAST(text AS string) AS text")
    want = Tokenizer.from_file(WORD).encode("good \ufffd\ufffd text", add_special_tokens=False).ids + [2]
    rows = {r["doc_id"]: r for r in token_files(docs, WORD).collect()}
    assert rows[1]["n_tokens"] == len(want) and rows[1]["ids_crc32"] == zlib.crc32(raw(want))
    assert encode_and_decode(docs, BYTE).count() == 2


def test_tokenizers_of_another_make(spark, odd):
    from quire.llm.token_files import WordEncoder, splits_words

    words, other = open(WORD, encoding="utf-8").read(), open(BYTE, encoding="utf-8").read()
    assert splits_words(words) and not splits_words(other)
    texts = [r["text"] or "" for r in odd.collect()]
    t = Tokenizer.from_str(other)
    assert WordEncoder(other).encode([x.encode() for x in texts]) == [raw(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_repeated_ids_are_in_several_tasks(spark):
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(400)] + [(None, f"more {i}") for i in range(100)] + [(9, "last")], "doc_id long, text string")
    rows = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files(docs, WORD, file_ids=50).collect()), key=lambda r: r[0])
    assert [r[0] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
    assert [r[1] for r in rows] == [None] * 100 + [5] * 400 + [9]
