"""op1 against a plain version: which words each document gives."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import mixing


def plain(rows, block=mixing.BLOCK_WORDS, seed=mixing.SEED):
    """Streams, blocks, slots and pieces by loops over (uid, doc_id, source, size, bucket)."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in sources]
    goal = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    keys = [int(mixing.mixed(np.array([seed * 1000003 + i]))[0] >> np.uint64(34)) for i in range(len(sources))]
    plans = [mixing.slot_plan(n, t, k, block) for n, t, k in zip(sizes, goal, keys)]
    streams = []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s and r["size"]), key=lambda r: (r["bucket"], r["doc_id"] is not None, r["doc_id"] or 0, r["uid"]))
        streams.append([(r["uid"], w) for r in own for w in range(r["size"])])
    taken, used = Counter(), defaultdict(list)
    wanted = [n for n, _ in plans]
    for shard in range(-(-sum(wanted) // mixing.SHARD_SLOTS)):
        for i, (first, n) in enumerate(zip(*mixing.shard_counts(shard, wanted, seed=seed))):
            blocks = -(-sizes[i] // block)
            for place in range(int(first), int(first + n)):
                at = int(mixing.permuted(*(np.array([x], dtype=np.int64) for x in (place % blocks, blocks, keys[i] + place // blocks)))[0])
                words = streams[i][at * block : (at + 1) * block][: plans[i][1] if place == wanted[i] - 1 else block]
                used[i].append(at)
                for uid, w in words:
                    taken[uid, w] += 1
    return taken, used


def test_words_against_plain_version(spark, odd, small):
    for docs in (small, odd):
        sized, pieces = mixing.mix(docs)
        buckets = mixing.bucket_count(sized.count(), mixing.ROWS_PER_BUCKET)
        rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(buckets))).collect()
        want, used = plain([r.asDict() for r in rows])
        got = Counter()
        for p in pieces.collect():
            for w in range(p["first"], p["first"] + p["words"]):
                got[p["uid"], w] += 1
        assert got == want
        for at in used.values():  # no block a second time before all once
            n = max(at) + 1
            assert all(len(set(at[low : low + n])) == len(at[low : low + n]) for low in range(0, len(at), n))
