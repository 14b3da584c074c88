"""Exact n-gram Jaccard join by multiple global orders, and the components of its links.

A text's set is its distinct shingles of `words` words (4 in the query), as 64-bit hashes. Equal sets are one node. Three global orders
rank all shingles. Two sets with 100 * intersection >= T * union share at least one shingle of their prefixes
(the first n - ceil(T n / 100) + 1) under every order, and k of prefixes k - 1 longer. The first order, by hash,
takes the longer prefixes. Of these, the second order, rarest first, needs only the first
(length - needed + 1): two prefixes that share `needed` shingles share one there. So very common shingles
give candidates only to texts that consist of them. A candidate must then share prefix shingles under two further
orders as well: the prefixes of the candidates' nodes under these are made where their texts lie and joined to the
pairs, and only the pairs that every filter leaves have their texts fetched and their sets compared.

Links of large groups are not listed pair by pair: in STARS rounds each shingle's nodes are compared with
one of them, then only those that its component has not reached. Then each node left joins the family of a hub,
a node that shares prefix shingles with many, and is written as its difference from the family's middle set. Two sets of a
family differ by what their differences do not share, so those must share at least (w + w') / 2 shingles, where
w is a difference's size less 15 / 185 of the set's; prefixes of the differences, rarest first, give a family's
candidates, and an edit that one text alone has gives none. A node that meets a second family is its guest, and
is compared there too. The last round compares the candidates that share
no family and are still in different components. Every link lies inside a component, and none that would join
two is missed.

Defined cases: a null text and one without words have the empty set and no links; with fewer words than a
shingle the whole sequence is one; texts of any length are read whole; repeated rows share a component; rows without
doc_id take no part, their component_id is null; bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty
result; further columns, whatever their names, are not read by the join and are kept by one_of_each.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import packed, short_batches, sound, written
from .sharding import mixed

WORDS = 4
PERCENT = 85
#: Prefixes are longer by so many hundredths of the set than one shared shingle asks.
LONGER = 10
STARS = 1
CACHE_WORDS = 300_000
#: Sets that a comparing worker remembers.
CACHE_SETS = 1500
STEP = np.uint64(0x9E3779B97F4A7C15)
OTHER_ORDER = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_hashes = _Hashes()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; ascending hashes are the first order."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, split), dtype=np.uint64, count=len(split))
    wide = min(words, len(h))
    out = np.full(len(h) - wide + 1, wide, dtype=np.uint64)
    for i in range(wide):
        out = mixed(out * STEP + h[i : len(h) - wide + 1 + i])
    return np.unique(out)


def shared_needed(n, longer: int = LONGER):
    """k: shingles that linked sets share in their prefixes."""
    return np.maximum(1, -(-n * longer // 100))


def prefix_length(n: int, k: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-n * percent // 100) + k)


def node_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def further_prefixes(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """A set's prefixes under the third and fourth order: descending hashes, and hashes mixed anew."""
    length = prefix_length(len(s), 1, percent)
    return s[len(s) - length :], np.sort(mixed(s ^ OTHER_ORDER))[:length]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact comparison."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def released(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles, whose files are then removed."""
    gc.collect()
    spark._jvm.System.gc()


def sets(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Written: doc_id, hash (of the text), node, n, prefix (of the first order)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t or b"", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "hash": batch.column(2), "node": pa.array([node_of(s) if len(s) else None for s in found], pa.int64()),
                "n": pa.array([len(s) for s in found], pa.int64()),
                "prefix": pa.array([s[: prefix_length(len(s), int(shared_needed(len(s))), percent)].view(np.int64) for s in found], pa.list_(pa.int64())),
            })

    with short_batches(docs.sparkSession):
        return written(_texts(docs).mapInArrow(run, "doc_id long, hash long, node long, n long, prefix array<long>"), "sets")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), sound("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))


def _fits(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _needed(n) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(n * LONGER / 100))


def filtered(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, words: int) -> DataFrame:
    """Written: the pairs (a, b) whose prefixes meet under the third and the fourth order too. Texts stay where they lie;
    only prefixes are moved."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = ends.join(nodes.select("node", F.col("low").alias("doc_id")), "node")
    found = _texts(docs).join(wanted, "doc_id").select("node", "text")
    longs = pa.list_(pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(node, shingles(text or b"", words)) for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            # Where an id has several texts, the join also meets those that are not the node's.
            own = [(node, further_prefixes(s, percent)) for node, s in rows if len(s) and node_of(s) == node]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([n for n, _ in own], pa.int64()), "third": pa.array([x[0].view(np.int64) for _, x in own], longs), "fourth": pa.array([x[1].view(np.int64) for _, x in own], longs),
            })

    with short_batches(docs.sparkSession):
        prefixes = written(found.mapInArrow(run, "node long, third array<long>, fourth array<long>").dropDuplicates(["node"]), "prefixes")
    sides = [prefixes.select(F.col("node").alias(x), F.col("third").alias(f"third_{x}"), F.col("fourth").alias(f"fourth_{x}")) for x in ("a", "b")]
    meet = F.arrays_overlap("third_a", "third_b") & F.arrays_overlap("fourth_a", "fourth_b")
    return written(pairs.join(sides[0], "a").join(sides[1], "b").filter(meet).select("a", "b"), "filtered")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Written: the pairs (a, b) of nodes that are linked: those that all filters leave are compared by their texts."""
    pairs = filtered(pairs, docs, nodes, percent, words)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = ends.join(nodes.select("node", F.col("low").alias("doc_id")), "node")
    texts = _texts(docs).join(wanted, "doc_id").select("node", "text")
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def known(node: int, text: pa.Scalar) -> np.ndarray | None:
            if node not in held:
                found = shingles(text.as_py() or b"", words)
                # Where an id has several texts, the join also meets those that are not the node's.
                if not len(found) or node_of(found) != node:
                    return None
                if len(held) >= CACHE_SETS:
                    held.clear()
                held[node] = found
            return held[node]

        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                one, other = known(x, batch.column(2)[i]), known(y, batch.column(3)[i])
                keep.append(one is not None and other is not None and linked(one, other, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    with short_batches(docs.sparkSession):
        return written(both.mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach, for nodes with links. Labels pass to neighbours,
    and each label is then replaced by its own label, until none changes: labels only fall, so that comes."""
    spark = links.sparkSession
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        heard = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("component"))
        up = labels.select(F.col("node").alias("up_node"), F.col("component").alias("up"))
        new = written(nearer.join(up, F.col("component") == F.col("up_node"), "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        labels = new.select("node", "component")
        if not new.filter("old <> component").head(1):
            return labels
        released(spark)


def indexed(rows: DataFrame, percent: int) -> DataFrame:
    """Written: token, node, n; the shingles by which candidates meet."""
    spark = rows.sparkSession
    entries = rows.dropDuplicates(["node"]).select("node", "n", F.size("prefix").alias("length"), F.explode("prefix").alias("token"))
    shared = written(entries.withColumn("g", F.count("*").over(W.partitionBy("token"))).filter("g > 1"), "shared")
    released(spark)
    by_node = W.partitionBy("node")
    rank = F.row_number().over(by_node.orderBy("g", "token"))  # after the node's shingles that no other has
    needed = _needed(F.ceil(F.col("n") * percent / 100))
    ranked = shared.withColumn("place", rank + F.col("length") - F.count("*").over(by_node))
    return written(ranked.filter(F.col("place") <= F.col("length") - needed + 1).select("token", "node", "n"), "index")


def placed(index: DataFrame, part: DataFrame | None) -> DataFrame:
    """The index with each node's component, and whether it is the one of most of its shingle's nodes (is_top);
    shingles whose nodes are all in one component go."""
    rows = index.join(part, "node", "left").withColumn("component", F.coalesce("component", "node")) if part is not None else index.withColumn("component", F.col("node"))
    by_token = W.partitionBy("token")
    tops = (
        rows.groupBy("token", "component").agg(F.count("*").alias("m"))
        .withColumn("parts", F.count("*").over(by_token)).withColumn("top", F.max(F.struct("m", "component")).over(by_token))
        .filter((F.col("parts") > 1) & (F.col("component") == F.col("top.component"))).select("token", F.col("component").alias("top"))
    )
    return rows.join(tops, "token").withColumn("is_top", F.col("component") == F.col("top")).drop("top")


def stars(index: DataFrame, part: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Written: a, b. Each shingle's nodes against one of its largest component, two partners a node at most:
    those met by most shingles. What this leaves out stays for the last round."""
    rows = placed(index, part)
    pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("a"), F.col("n").alias("an"), F.col("component").alias("ac"))).alias("p")
    pivots = rows.filter("is_top").groupBy("token").agg(pivot).select("token", "p.a", "p.an", "p.ac")
    met = (
        rows.join(pivots, "token").filter((F.col("component") != F.col("ac")) & _fits("n", "an", percent))
        .groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    )
    first = F.row_number().over(W.partitionBy("b").orderBy(F.desc("c"), "a"))
    return written(met.withColumn("r", first).filter("r <= 2").select("a", "b"), "stars")


def hubs(rest: DataFrame) -> DataFrame:
    """Written: node, hub. Each shingle names the node that meets most others; a node takes the hub most of its shingles name."""
    by_token = W.partitionBy("token")
    met = rest.select("token", "node", F.count("*").over(by_token).alias("g"))
    degree = F.struct(F.sum("g").over(W.partitionBy("node")).alias("met"), F.col("node").alias("hub"))
    named = met.withColumn("degree", degree).select("node", F.max("degree").over(by_token).alias("top"))
    votes = named.groupBy("node", "top").agg(F.count("*").alias("c"))
    return written(votes.groupBy("node").agg(F.max(F.struct("c", "top")).alias("best")).select("node", F.col("best.top.hub").alias("hub")), "hubs")


def differences(family: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """Written: node, hub, n, n_hub, size and shingles of the symmetric difference, whether the two are linked."""
    ends = family.select("node").union(family.select("hub")).distinct()
    wanted = ends.join(nodes.select("node", F.col("low").alias("doc_id")), "node")
    texts = _texts(docs).join(wanted, "doc_id").select("node", "text")
    both = (
        family.join(texts.hint("merge"), "node")
        .join(texts.select(F.col("node").alias("hub"), F.col("text").alias("text_hub")).hint("merge"), "hub")
        .select("node", "hub", "text", "text_hub")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("node", "hub", "n", "n_hub", "size", "linked", "diff")}
            for i, (node, hub) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = shingles(batch.column(2)[i].as_py() or b"", words)
                # Where an id has several texts, the join also meets those that are not the node's.
                if not len(own) or node_of(own) != node:
                    continue
                if hub != held[0]:
                    found = shingles(batch.column(3)[i].as_py() or b"", words)
                    if not len(found) or node_of(found) != hub:
                        continue
                    held = (hub, found)
                diff = np.setxor1d(own, held[1], assume_unique=True)
                union = (len(own) + len(held[1]) + len(diff)) // 2
                row = (node, hub, len(own), len(held[1]), len(diff), 100 * (union - len(diff)) >= percent * union, diff.view(np.int64))
                for c, x in zip(out, row):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], t) for c, t in zip(out, [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64())])], names=list(out)
            )

    with short_batches(docs.sparkSession):
        return written(both.mapInArrow(run, "node long, hub long, n long, n_hub long, size long, linked boolean, diff array<long>"), "differences")


def centred(diffs: DataFrame, percent: int) -> DataFrame:
    """Written: the families that hold a member not linked to the hub, hubs among the members, as differences from
    the member nearest to all others: |X xor Y| summed over Y changes by members - 2 * count for each shingle of
    X's difference, where count is that of the family's differences with the shingle."""
    whole = diffs.groupBy("hub").agg(F.min("linked").alias("all"), (F.count("*") + 1).alias("members"), F.min("n_hub").alias("n_hub")).filter("NOT all AND members > 2").drop("all")
    own = whole.select(F.col("hub").alias("node"), "hub", F.col("n_hub").alias("n"), F.array().cast("array<long>").alias("diff"), "members")
    rows = written(diffs.select("node", "hub", "n", "diff").join(whole.select("hub", "members"), "hub").select(own.columns).union(own), "members")
    counted = rows.select("hub", "node", "members", F.explode("diff").alias("token")).withColumn("g", F.count("*").over(W.partitionBy("hub", "token")))
    far = counted.groupBy("hub", "node").agg(F.sum(F.col("members") - 2 * F.col("g")).alias("far"))
    nearest = far.groupBy("hub").agg(F.min(F.struct("far", "node")).alias("best")).filter("best.far < 0").select("hub", F.col("best.node").alias("node"))
    middle = rows.join(nearest, ["hub", "node"]).select("hub", F.col("node").alias("middle"), F.col("diff").alias("mid"), F.col("n").alias("n_mid"))
    moved = rows.join(whole.select("hub", "n_hub"), "hub").join(middle, "hub", "left").select(
        "node", "hub", F.coalesce("middle", "hub").alias("middle"), "n", F.coalesce("n_mid", "n_hub").alias("n_hub"),
        F.when(F.col("mid").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "mid"), F.array_except("mid", "diff"))).alias("diff"),
    )
    size = F.size("diff").cast("long")
    union = ((F.col("n") + F.col("n_hub") + size) / 2).cast("long")
    return written(moved.withColumn("size", size).withColumn("linked", 100 * (union - size) >= percent * union), "centred")


def family_pairs(diffs: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """a, b: candidates of one family in different components.

    Sets X and Y link where |X xor Y| * (100 + T) <= (100 - T) * (|X| + |Y|). With w = (100 + T) * size - (100 - T) * n
    of each, their differences share at least (w + w') / (2 * (100 + T)). Members linked to their middle are in its
    component, so one of a pair is not: its w is above (100 - T) * n_hub, and any partner shares more than
    (w + (100 - T) * n_hub) / (2 * (100 + T)), which is never below 0. Of the one that is not linked, a linked
    partner asks only for what the triangle of the three sets leaves."""
    less, more = 100 - percent, 100 + percent
    placed_ = diffs.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A family of one component, or without a member that its hub does not reach, has no candidates.
    open_hubs = (
        placed_.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("linked").alias("all_linked"))
        .filter("low < high AND NOT all_linked").select("hub")
    )
    entries = placed_.join(open_hubs, "hub").select("hub", "node", "n", "n_hub", "size", "linked", "component", F.explode("diff").alias("token"))
    by_token = W.partitionBy("hub", "token")
    shared = (
        entries.withColumn("g", F.count("*").over(by_token)).withColumn("alone", F.min("linked").over(by_token))
        .filter((F.col("g") > 1) & ~F.col("alone"))
    )
    by_node = W.partitionBy("hub", "node")
    place, length = F.row_number().over(by_node.orderBy("g", "token")), F.count("*").over(by_node)
    w = more * F.col("size") - less * F.col("n")
    any_partner = F.floor((w + less * F.col("n_hub")) / (2 * more)) + 1
    # A linked partner has at most n_hub * 100 / T shingles, and n * 100 / T.
    widest = F.floor(F.least("n", "n_hub") * 100 / percent)
    linked_partner = F.greatest(F.lit(1), F.ceil((w - less * widest) / more))
    ranked = shared.withColumn("place", place).withColumn("length", length)
    short = F.col("place") <= F.col("length") - any_partner + 1
    long = ~F.col("linked") & (F.col("place") <= F.col("length") - F.least(any_partner, linked_partner) + 1)
    left = F.col("length") - F.col("place") + 1
    index = written(
        ranked.withColumn("short", short).filter(short | long).withColumn("w", w).withColumn("left", left)
        .select("hub", "token", "node", "n", "w", "left", "linked", "component", "short"), "family",
    )
    one = index.filter(~F.col("linked")).select("hub", "token", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "w", "left", "component", "short")))
    two = index.filter("short").select("hub", "token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "w", "left", "component", "linked")))
    # At the first shingle that two differences share, what is left of either must hold all that they need to share.
    enough = 2 * more * F.least("left1", "left2") >= F.col("w1") + F.col("w2")
    met = one.join(two.hint("merge"), ["hub", "token"]).filter(
        (F.col("component1") != F.col("component2")) & (F.col("linked2") | (F.col("short1") & (F.col("node1") < F.col("node2")))) & enough & _fits("n1", "n2", percent)
    )
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def across(rest: DataFrame, family: DataFrame) -> DataFrame:
    """Written: the shingles whose nodes are in several families, with each node's hub and the shingle's top family."""
    rows = rest.drop("is_top", "component").join(family, "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    by_token = W.partitionBy("token")
    tops = (
        rows.groupBy("token", "hub").agg(F.count("*").alias("m"))
        .withColumn("parts", F.count("*").over(by_token)).withColumn("top", F.max(F.struct("m", "hub")).over(by_token))
        .filter((F.col("parts") > 1) & (F.col("hub") == F.col("top.hub"))).select("token", F.col("hub").alias("top"))
    )
    return written(rows.join(tops, "token"), "across")


def guests(rows: DataFrame) -> DataFrame:
    """Written: node, guest. A node outside its shingles' top families is also a member of the one that most name."""
    named = rows.filter("hub <> top").groupBy("node", "top").agg(F.count("*").alias("c"))
    return written(named.groupBy("node").agg(F.max(F.struct("c", "top")).alias("best")).select("node", F.col("best.top").alias("guest")), "guests")


def far_pairs(rows: DataFrame, part: DataFrame, guest: DataFrame, percent: int) -> DataFrame:
    """a, b: candidates that share no family, in different components. Each shingle's nodes that are not in its top
    family, as member or guest, meet all others."""
    placed_ = rows.join(guest, "node", "left").join(part, "node", "left").select(
        "token", "node", "n", "hub", F.coalesce("guest", "hub").alias("guest"), F.coalesce("component", "node").alias("component"),
        ((F.col("hub") == F.col("top")) | F.coalesce(F.col("guest") == F.col("top"), F.lit(False))).alias("is_top"),
    )
    rest = written(placed_, "rest")
    one = rest.filter(~F.col("is_top")).select("token", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "component", "hub", "guest")))
    two = rest.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "component", "hub", "guest", "is_top")))
    apart = (F.col("component1") != F.col("component2")) & ~F.col("hub1").isin(F.col("hub2"), F.col("guest2")) & ~F.col("guest1").isin(F.col("hub2"), F.col("guest2"))
    met = one.join(two.hint("merge"), "token").filter(apart & (F.col("is_top2") | (F.col("node1") < F.col("node2"))) & _fits("n1", "n2", percent))
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def join_components(docs: DataFrame, percent: int = PERCENT, rounds: int = STARS, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return joined(docs, percent, rounds, words).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def joined(docs: DataFrame, percent: int = PERCENT, rounds: int = STARS, words: int = WORDS) -> DataFrame:
    """doc_id, hash, n, component_id, first (the component's smallest doc_id and text hash) of every row."""
    spark = docs.sparkSession
    rows = sets(docs, percent, words)
    usable = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = written(usable.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "hash")).alias("first")), "nodes")
    index = indexed(usable, percent)
    released(spark)
    tried, links, part = None, spark.createDataFrame([], "a long, b long"), None
    for turn in range(rounds):
        pairs = stars(index, part, turn, percent)
        found = verified(pairs, docs, nodes, percent, words)
        tried = pairs if tried is None else tried.union(pairs)
        links = links.union(found)
        part = components(links)
        released(spark)

    rest = written(placed(index, part), "rest")
    family = hubs(rest)
    several = across(rest, family)
    guest = guests(several)
    members = family.union(guest.select("node", "guest")).filter("node <> hub")
    diffs = differences(members, docs, nodes, percent, words)
    middles = centred(diffs, percent)
    links = links.union(diffs.filter("linked").select("node", "hub")).union(middles.filter("linked AND node <> middle").select("node", "middle"))
    part = components(links)
    released(spark)
    candidates = family_pairs(middles, part, percent).union(far_pairs(several, part, guest, percent)).distinct()
    if tried is not None:
        candidates = candidates.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    candidates = written(candidates, "candidates")
    released(spark)
    if candidates.head(1):
        more = verified(candidates, docs, nodes, percent, words)
        if more.head(1):
            part = components(links.union(more))
    ends = nodes.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = ends.groupBy("component").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    ids = ends.drop("first").join(lowest, "component").select("node", "component_id", "first")
    released(spark)
    return rows.join(ids, "node", "left").select("doc_id", "hash", "n", "component_id", "first")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The input's rows less those of a component other than its smallest doc_id and text; rows alike in both become
    one, so texts that only share a doc_id stay. Rows without doc_id or without words stay."""
    keys = ["id", "hash"]
    others = joined(docs, **options).filter("doc_id IS NOT NULL AND n > 0 AND (doc_id <> first.doc_id OR hash <> first.hash)")
    gone = others.select(F.col("doc_id").alias("id"), "hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), packed(docs).alias("row"))
    # Texts are shuffled once: rows alike meet, and meet those that go, by the same keys.
    named = rows.filter("id IS NOT NULL").dropDuplicates(keys).join(gone, keys, "left_anti")
    return named.select("row").union(rows.filter("id IS NULL").select("row")).select("row.*")
