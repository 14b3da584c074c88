"""Sharding and mixing."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from quire.llm.mixing import mix, mixed_documents, permuted, place_of, shard_counts, slot_plan, taken, targets
from quire.llm.sharding import jump_hash, mixed, shard_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def jump_plain(key, shards):
    key, b, j = int(mixed(np.array([key], dtype=np.int64).view(np.uint64))[0]), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_a_plain_loop_and_moves_little():
    keys = np.array([0, 1, -1, 2**62, *range(10, 3000)], dtype=np.int64)
    eight, nine = (jump_hash(keys.view(np.uint64), n) for n in (8, 9))
    assert [int(x) for x in eight[:200]] == [jump_plain(int(k), 8) for k in keys[:200]]
    assert set(nine[nine != eight]) == {8}
    assert abs((nine == 8).mean() - 1 / 9) < 0.03


def check_shards(rows, docs):
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
    for r in rows:
        assert r["shard"] == jump_plain(r["doc_id"] if r["doc_id"] is not None else 0x6E756C6C, 8)
        assert r["grown_shard"] in (r["shard"], 8)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(odd, none, small, monkeypatch):
    monkeypatch.setattr("quire.llm.sharding.ROWS_PER_BUCKET", 64)
    for docs in (odd, small):
        check_shards(shard_documents(docs).collect(), docs.collect())
    assert shard_documents(none).collect() == []


def test_targets_share_the_excess():
    assert targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 0], [5, 2, 1]) == [30.0, 980.0, 0.0]
    assert targets([], []) == []


def test_permutation_and_slots_hit_the_target():
    for size in (1, 2, 3, 17, 1000):
        at = permuted(np.arange(size), np.full(size, size), np.full(size, 99))
        assert sorted(at) == list(range(size))
        assert all(place_of(int(b), size, 99) == i for i, b in enumerate(at))
    for size in (1, 63, 64, 65, 200, 6400):
        for target in (0, 1, size // 2, size, size * 1.7, size * 3):
            slots, last = slot_plan(size, target, 5)
            blocks = -(-size // 64)
            words = 0
            for place in range(slots):
                one = np.array([place % blocks]), np.array([blocks]), np.array([5 + place // blocks])
                block = int(permuted(*one)[0])
                held = min(64, size - block * 64)
                words += min(held, last) if place == slots - 1 else held
            assert words == round(target), (size, target)


def test_shard_draws_add_up():
    wanted = [100, 0, 50_000, 3, 40_000]
    sums, at = Counter(), [0] * 5
    for shard in range(6):
        first, count = shard_counts(shard, wanted)
        assert first.tolist() == at and count.sum() == min(16384, sum(wanted) - shard * 16384)
        at = (first + count).tolist()
        again = shard_counts(shard, wanted)
        assert again[1].tolist() == count.tolist()
    assert at == wanted and shard_counts(0, [7])[1].tolist() == [7]


def check_mix(docs):
    rows = taken(*mix(docs)).collect()
    plain = docs.collect()
    size = Counter((r["doc_id"], len(WORDS.findall(r["text"] or ""))) for r in plain)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == size
    whole, got, goal = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        whole[r["source"]] += r["size"]
        got[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(r["source_size"] == whole[r["source"]] for r in rows)
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal)
    assert abs(sum(goal.values()) - sum(whole.values())) < 1e-6
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(map(key, rows), key=str) == sorted(map(key, taken(*mix(docs)).collect()), key=str)


def test_mix(odd, none, small, monkeypatch):
    monkeypatch.setattr("quire.llm.mixing.ROWS_PER_BUCKET", 16)
    check_mix(odd)
    check_mix(small)
    assert taken(*mix(none)).collect() == []


def test_mixed_documents_hold_what_is_taken(small):
    words = {r["doc_id"]: r["taken"] for r in taken(*mix(small)).collect()}
    out = mixed_documents(small)
    assert out.columns == small.columns
    for r in out.collect():
        assert len(WORDS.findall(r["text"])) == words.pop(r["doc_id"])
        assert r["n_chars"] == len(r["text"])
    assert not any(words.values())


def test_mixed_documents_keep_any_columns(spark):
    names = ("id", "no_id", "hash", "row", "cuts", "new", "uid", "_id", "_hash", "_cuts")
    docs = spark.createDataFrame([(i, f"words of the text {i} " * 5, "a", 0, *names) for i in (1, 1, 2)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    rows = mixed_documents(docs)
    got = rows.collect()
    assert rows.columns == docs.columns and {r["doc_id"] for r in got} <= {1, 2} and all(r[n] == n for r in got for n in names)
