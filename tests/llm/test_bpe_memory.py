"""What byte-pair encoding holds: short batches from the JVM, and nothing but the merges between tasks."""

import public_tokenizers
import pyarrow as pa

from quire.llm import bpe
from quire.llm._shared import BATCH_ROWS

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_texts_come_in_short_batches(spark, monkeypatch):
    docs = spark.range(3 * BATCH_ROWS, numPartitions=1).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    real = bpe._mapped

    def sizes(docs, path, row, schema):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n] * n, pa.int64()), pa.array([""] * n), pa.array([""] * n)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    monkeypatch.setattr(bpe, "_mapped", sizes)
    seen = {r["n_tokens"] for r in bpe.encode_and_decode(docs, BYTE).collect()}
    monkeypatch.setattr(bpe, "_mapped", real)
    assert max(seen) <= BATCH_ROWS, seen


def test_a_waiting_worker_keeps_no_words(spark):
    docs = spark.range(1000, numPartitions=1).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    assert bpe.encode_and_decode(docs, BYTE).count() == 1000

    def known(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(c.known) for c in bpe._encoders.values())], pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(known, "n long").collect()} == {0}
