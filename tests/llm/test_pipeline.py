import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.jaccard_join import join_components
from quire.llm.mixing import mixed_documents
from quire.llm.quality_rules import quality_rules
from quire.llm.secrets import scan

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules(docs, labels).collect() if r["kept"]}
            assert after == {i: r for i, r in before.items() if i in kept}
        if name == "jaccard_join":
            assert after == {i: before[i] for i in {r["component_id"] for r in join_components(docs).collect()}}
        if name == "secret_scan":
            spans = {r["doc_id"]: r["spans"] for r in scan(docs).collect()}
            assert after.keys() == before.keys() and all((after[i] == before[i]) == (not spans[i]) for i in after)
            assert all(after[i]["text"].count("[SECRET]") >= 1 for i in after if spans[i])
            assert not any(r["n_hex"] + r["n_access"] for r in scan(out).collect())
        if name == "mix_sources":
            assert after == {r["doc_id"]: r for r in mixed_documents(docs).collect()}
        if name == "bpe":
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for i, r in before.items():
                ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids, dtype="<u4")
                assert (after[i]["n_tokens"], after[i]["ids_sha256"], after[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        else:
            assert out.columns == columns
        seen.append(name)
        docs = out
    assert len(seen) == 5


def test_odd_documents_pass_through(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.collect()
