import hashlib
import re

from quire.llm.pii import sanitised, scan


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
]
TEXTS = [
    None, "", "a@b.c_d@e.f, x..y%+-@q-.com.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3", "4111 1111 1111 1111 4111-1111 11111111, 4111111111111112",
    "é😀 +1 (415) 555-0100 and +12 +1234567890123456 +1-2-3-4-5-6-7-8-9-0-", "+1 ((((((9 @ . 9.9.9.9a@b", "me@here@there.org 5500005555555559 79927398713",
    "9" * 4000 + " " + "a" * 4000 + "@" + "1." * 3000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "0" * 16,
]


def brute(text):
    out = []
    for k, (kind, pattern, keep) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if keep(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def check(docs):
    rows, want = scan(docs).collect(), {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(brute(r["text"]))
    assert len(rows) == sum(map(len, want.values()))
    for r in rows:
        base = want[r["doc_id"]].pop()
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (r, base)
        assert [r[f"n_{k}"] for k, *_ in PATTERNS] == [sum(s.startswith(k) for s in base) for k, *_ in PATTERNS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("term")] == base
    return rows


def test_base_spans_against_brute_force(spark, odd, none, small):
    check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    check(odd)
    check(small)
    assert scan(none).collect() == []


def test_terms_that_disclose(spark):
    texts = [f"line {i} Zebedee writes from zed@corp.example about thing{'abcdefgh'[i]} today" for i in range(5)]
    texts += ["Nobody knows Zebedee here"] + [f"people writes from home about plain matters today {i}" for i in range(30)]  # counts are of distinct texts
    texts += ["copied secretword near you@corp.example"] * 40
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert spans[5] == "term:13:20" and "term:7:14" in spans[0]
    assert all(spans[i] == "" for i in range(6, 36)) and all("term" not in spans[i] for i in range(36, 76))


def disclosing_terms(texts):
    """Plain counts over distinct texts: a term leaves one bit of an entity, at most, and stands near it in three."""
    near, holders, holds = {}, {}, {}
    for text in set(texts):
        for term in set(re.findall(r"[^\W\d_]{4,}", text.lower())):
            holds.setdefault(term, set()).add(text)
        for span in brute(text):
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            left, right = text[max(0, a - 60) : a], text[b : b + 60]
            left = re.sub(r"^[^\W\d_]+", "", left) if a > 60 else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(right) == 60 else right
            holders.setdefault((kind, text[a:b]), set()).add(text)
            for term in set(re.findall(r"[^\W\d_]{4,}", (left + "\n" + right).lower())):
                near.setdefault(((kind, text[a:b]), term), set()).add(text)
    return {t for (_, t), x in near.items() if len(x) >= 3 and 2 * len(x) >= len(holds[t])}


def test_term_spans_against_plain_counts(spark):
    import random

    rng = random.Random(2)
    names, words = ["Zebedee", "Quillon", "Orsolya"], ["people", "write", "about", "plain", "matters", "today", "always", "never"]
    texts = []
    for i in range(120):
        body = " ".join(rng.choices(words, k=25))
        name = names[i % 3]
        texts.append(f"{body} {name if rng.random() < 0.8 else ''} {name.lower()}@corp.example {rng.choice(words)} {body[:30]}" if i % 4 == 0 else f"{body} {rng.choice(names) if rng.random() < 0.02 else ''} {i}")
    texts += texts[:6] * 5
    terms = disclosing_terms(texts)
    assert {"zebedee", "quillon", "orsolya"} & terms and not set(words) & terms
    for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        text, base = texts[r["doc_id"]], brute(texts[r["doc_id"]])
        taken = [tuple(map(int, s.split(":")[1:])) for s in base]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{4,}", text) if m[0].lower() in terms and not any(m.start() < b and a < m.end() for a, b in taken)]
        assert [s for s in r["spans"].split(",") if s.startswith("term")] == want


def test_long_text_with_a_disclosing_term(spark):
    import time

    texts = [f"line {i} Zebedee writes from zed@corp.example about thing{'abcdefgh'[i]} today" for i in range(5)]
    texts.append("some words of plain prose go on here " * 11_000 + "Zebedee " * 2_000)
    began = time.time()
    rows = {r["doc_id"]: r["spans"] for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[5].count("term") == 2_000 and time.time() - began < 30, time.time() - began


def test_sanitised(spark):
    docs = spark.createDataFrame([(1, "to a@b.co now", "x"), (2, None, "y")], "doc_id long, text string, spans string")
    assert sorted(map(tuple, sanitised(docs).collect())) == [(1, "to [EMAIL] now", "x"), (2, None, "y")]
    texts = [f"line {i} Zebedee writes from zed@corp.example today" for i in range(5)]
    got = {r["doc_id"]: r for r in sanitised(spark.createDataFrame([(i, t, "h", "c") for i, t in enumerate(texts)], "doc_id long, text string, hash string, carried string")).collect()}
    assert "Zebedee" not in got[0]["text"] and "[EMAIL]" in got[0]["text"] and got[0]["hash"] == "h" and got[0]["carried"] == "c"
