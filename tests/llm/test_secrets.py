import hashlib
import re

from quire.llm.secrets import labelled_samples, redacted, scan

PATTERNS = [
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
TEXTS = [
    None, "", "password=abcdefgh", "password=abcdefg", "token: token=abcdefgh", "token=api_key:abcdefghijk", 'API_KEY" : \'a.b=c/d+e_f',
    "é😀 Secret = 12345678 and AKIA0123456789AB AKIAAKIA0123456789 AKIA12 " + "0f" * 16 + "g" + "a" * 31, "ſecret=12345678 toKen=12345678",
    "see Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg8Qx7Lp in the_max_retry_count_value_10 config", "x" * 100_000 + " passwd=" + "9" * 50_000,
]


def brute(text):
    out = []
    for k, (kind, pattern, keep) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if keep(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def check(docs):
    rows = scan(docs).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(brute(r["text"]))
    assert len(rows) == sum(map(len, want.values()))
    for r in rows:
        base = want[r["doc_id"]].pop()
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), r
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans) and [s for s in spans if not s.startswith("markov")] == base
    return rows


def test_base_spans_against_brute_force(spark, odd, none, small):
    rows = check(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    assert "markov:4:40" in next(r["spans"] for r in rows if r["doc_id"] == 9) and "," not in next(r["spans"] for r in rows if r["doc_id"] == 9)
    check(odd)
    check(small)
    assert scan(none).collect() == []


def test_samples_are_labelled(small):
    n = {r["secret"]: r["count"] for r in labelled_samples(small).groupBy("secret").count().collect()}
    assert n[True] == 8000 and n[False] > 1000


def test_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b", 22, "x"), (2, "clean", 5, "y"), (3, None, None, None)], "doc_id long, text string, n_chars long, size string")
    assert sorted(map(tuple, redacted(docs).collect())) == [(1, "a [SECRET] b", 12, "x"), (2, "clean", 5, "y"), (3, None, None, None)]
    assert redacted(odd).columns == odd.columns and redacted(odd).count() == odd.count()


def test_model_does_not_depend_on_the_session(spark, small):
    from pyspark.sql import types as T

    from quire.llm.secrets import train

    before = train(labelled_samples(small))
    spark.udf.register("zz_q9_odd_function", lambda x: x, T.StringType())
    assert train(labelled_samples(small)) == before


def plain_ratio(token, model):
    from quire.llm.secrets import ALPHABET, CLASSES

    at = [ALPHABET.find(c) + 1 for c in token]
    return sum(round(model[a * CLASSES + b], 6) for a, b in zip(at, at[1:])) / (len(token) - 1)


def test_markov_spans_against_plain_ratios(spark, small):
    """The method's own spans, recall of random strings and what it says of ordinary identifiers."""
    import base64
    import random

    from quire.llm.secrets import THRESHOLD, TOKEN, train

    rng = random.Random(5)
    secrets = [base64.b64encode(rng.randbytes(24)).decode().strip("=") for _ in range(200)] + [rng.randbytes(12).hex() + "Q" for _ in range(100)]
    plain = [f"{a}_{b}_{c}_{n}" for a in ("maximum", "current", "default") for b in ("connection", "temperature", "document") for c in ("counter", "threshold") for n in range(10)]
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(secrets + plain)], "doc_id long, text string")
    samples = labelled_samples(small)
    model = train(samples)
    rows = {r["doc_id"]: r["spans"] for r in scan(docs, samples=samples).collect()}
    for i, t in enumerate(secrets + plain):
        want = [f"markov:{m.start()}:{m.end()}" for m in re.finditer(TOKEN, f"a {t} b") if plain_ratio(m[0], model) > THRESHOLD]
        assert [s for s in rows[i].split(",") if s.startswith("markov")] == want, t
    caught = sum("markov" in rows[i] for i in range(len(secrets))) / len(secrets)
    wrong = sum("markov" in rows[len(secrets) + i] for i in range(len(plain))) / len(plain)
    assert caught > 0.97 and wrong < 0.03, (caught, wrong)


def test_redaction_keeps_any_columns(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b", "t", "b", "s", "m", "c", "n")], "doc_id long, text string, _text string, _base string, spans string, more string, carried string, new string")
    assert [tuple(r) for r in redacted(docs).collect()] == [(1, "a [SECRET] b", "t", "b", "s", "m", "c", "n")]


def test_many_spans_in_a_long_text(spark):
    import time

    docs = spark.createDataFrame([(1, "password=abcdefgh1 " * 30_000)], "doc_id long, text string")
    began = time.time()
    (row,) = scan(docs, samples=docs.selectExpr("text AS token", "true AS secret").limit(0)).collect()
    assert row["n_assign"] == 30_000 and time.time() - began < 30
