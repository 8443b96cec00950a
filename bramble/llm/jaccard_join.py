"""Exact Jaccard join of shingle sets by vertical partitioning.

All shingles have one global order, from rare to frequent. It is cut into fragments of about equal weight, and each set into a segment
for each fragment. Segments of one fragment meet apart from all others and count their partial overlap; partial overlaps are summed per pair,
and the sum decides. A segment that misses more of its shingles than the whole set may, ends its pair there.

Any order gives the same links. This one sorts shingles by how many stand in their bucket, of BUCKETS, in all texts: what is in a bucket with few is
rare, and what is frequent has a bucket with many. So the order is a table of a fixed size that all tasks have, and sets are put in order where they are read.

Sets that are alike in `percent` share one of the first shingles of each, as many as a set may have for itself and one more (the prefix).
Frequent lines and passages stand last, so they bring no pairs together. Equal sets are one class from the start, and shingles that stand in the prefixes of the same sets are one group.
In a few rounds, each set is compared with the one that most of its groups have drawn; groups that still hold sets that no link joins are compared completely, small ones pair by pair if enough of
the prefixes is shared, large ones in blocks inside tasks. Keys that very many rows have are looked up in all tasks; by arithmetic there are at most 1 / HUB of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import LAST, key, small_or_not, table
from bramble.llm.near_dup import BLOCK_ELEMENTS, BLOCK_MEMBERS, FEW_IDS, FEW_MEMBERS, _forest, shingle_sets
from bramble.operators.components import connected_components, looked_up as _looked_up
from bramble.operators.graph import discard, stored

#: Fragments of the global order; rounds of comparing each group with one of its sets.
FRAGMENTS, ROUNDS = 8, 2
#: Buckets of shingles, whose counts give the order; in how many blocks tasks give their counts.
BUCKETS, BLOCKS = 1 << 18, 16
#: Sets, and shingles in them, that meet one set at once; columns of a matrix.
MEMBERS, ELEMENTS, WIDTH = 512, 500_000, 4096
Batches = Iterator[pa.RecordBatch]


def _missing(n, percent: int):
    """The shingles that a set of n may have for itself."""
    return n - (n * percent + 99) // 100


def _marks(elements: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Two hashes of each set: sums over its shingles."""
    sizes, out = np.diff(first), []
    for seed in (21, 22):
        total = np.r_[tv.U(0), np.cumsum(tv.mix(elements ^ tv.keys(seed, 1)[0]), dtype=tv.U)]
        out.append(pa.array(tv.mix(total[first[1:]] - total[first[:-1]] + sizes.astype(tv.U)).view(np.int64)))
    return out


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (tv.mix(elements ^ tv.keys(23, 1)[0]) & tv.U(BUCKETS - 1)).astype(np.int64)


_PROFILE = "row long, id long, doc long, n long, f1 long, f2 long, block int, counts array<long>"


def _profile(k: int) -> Callable[[Batches], Batches]:
    """Each text's size and marks; and, by block, how many shingles of the partition's texts each bucket has."""

    def run(batches: Batches) -> Batches:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in tv.slices(batches):
            elements, first = shingle_sets(batch.column(0), k)
            counts += np.bincount(_bucket(elements), minlength=BUCKETS)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(first)), *_marks(elements, first), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=["row", "id", "doc", "n", "f1", "f2", "block", "counts"])
        if counts.any():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BUCKETS + 1, BUCKETS // BLOCKS).astype(np.int32)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(BLOCKS, pa.int64())] * 6, pa.array(np.arange(BLOCKS).astype(np.int32)), lists], names=["row", "id", "doc", "n", "f1", "f2", "block", "counts"])

    return run


def _added(keys: tuple, batches: Batches) -> Batches:
    """The sum of the partitions' counts of one block."""
    total = np.zeros(BUCKETS // BLOCKS, dtype=np.int64)
    for batch in batches:
        for counts in batch.column(1):
            total += counts.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["block", "counts"])


def _order(base: DataFrame, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's place in the global order, and its fragment."""
    counts = np.zeros((BLOCKS, BUCKETS // BLOCKS), dtype=np.int64)
    for r in base.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_added, "block int, counts array<long>").collect():  # BUCKETS numbers
        counts[r.block] = r.counts
    counts = counts.ravel()
    order = np.argsort(counts, kind="stable")
    rank = np.empty(BUCKETS, dtype=np.int32)
    rank[order] = np.arange(BUCKETS)
    upto = np.cumsum(counts[order])
    fragment = np.empty(BUCKETS, dtype=np.int8)
    fragment[order] = np.minimum((upto - 1) * fragments // max(int(upto[-1]), 1), fragments - 1)
    return rank, fragment


def _in_order(shared, k: int, each: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """Runs over texts (text, node, f1), their shingles in the global order."""

    def run(batches: Batches) -> Batches:
        rank, fragment = shared.value
        for batch in tv.slices(batches):
            elements, first = shingle_sets(batch.column(0), k)
            if not np.array_equal(_marks(elements, first)[0].to_numpy(), batch.column(2).to_numpy()):
                raise ValueError("the documents came in another order than before; give a stored table")
            bucket, owner = _bucket(elements), np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((elements, rank[bucket], owner))
            yield each(elements[order].view(np.int64), fragment[bucket[order]], first, owner, batch)

    return run


def _prefixes(percent: int):
    def each(elements, fragment, first, owner, batch):
        sizes = np.diff(first)
        long = np.minimum(_missing(sizes, percent) + 1, sizes)
        offsets = np.r_[0, np.cumsum(long)]
        some = elements[np.repeat(first[:-1] - offsets[:-1], long) + np.arange(offsets[-1])]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(some))], names=["node", "n", "prefix"])

    return each


def _segments(elements, fragment, first, owner, batch):
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])][: len(owner)])
    tokens = pa.ListArray.from_arrays(pa.array(np.r_[new, len(owner)].astype(np.int32)), pa.array(elements))
    return pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner[new])), pa.array(fragment[new].astype(np.int32)), tokens], names=["node", "fragment", "tokens"])


def _compare_blocks(percent: int) -> Callable[[tuple, Batches], Batches]:
    """Links between two blocks of a group (or within one), as a spanning forest; partial overlaps are matrix products, added up over the fragments."""

    def run(keys: tuple, batches: Batches) -> Batches:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        name, fragment, lists = rows.column("node").to_numpy(), rows.column("fragment").to_numpy(), rows.column("tokens").combine_chunks()
        nodes, at, member = np.unique(name, return_index=True, return_inverse=True)
        sizes, side = rows.column("size").to_numpy()[at], rows.column("side").to_numpy()[at]
        both = np.zeros((len(nodes), len(nodes)), dtype=np.int64)
        for f in np.unique(fragment):
            some = np.flatnonzero(fragment == f)
            own = lists.take(pa.array(some))
            _, column, count = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
            row = np.repeat(member[some], np.diff(own.offsets.to_numpy()))
            shared = count[column] > 1  # others are in no intersection
            column = (np.cumsum(count > 1) - 1)[column[shared]]
            order = np.argsort(column, kind="stable")
            row, column = row[shared][order], column[order]
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
                a, b = np.searchsorted(column, [low, low + WIDTH])
                part = np.zeros((len(nodes), WIDTH), dtype=np.float32)
                part[row[a:b], column[a:b] - low] = 1
                both += (part @ part.T).astype(np.int64)  # at most WIDTH at a time, which float32 holds exactly
        link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        if keys[1].as_py() != keys[2].as_py():
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, False)
        edges = np.array(_forest(link), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[edges[:, 0]]), pa.array(nodes[edges[:, 1]])], names=["u", "v"])

    return run


def _partial(percent: int) -> Callable[[tuple, Batches], Batches]:
    """The partial overlaps of one set with some others in one fragment."""

    def run(keys: tuple, batches: Batches) -> Batches:
        u, nu, hub, others = keys[0].as_py(), 0, None, []
        for batch in batches:
            for node, n, tokens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5), strict=True):
                if node == u:
                    hub, nu = np.sort(tokens.values.to_numpy()), n
                else:
                    others.append((node, n, tokens.values.to_numpy()))
        if hub is None:  # it has none of its shingles here
            others = []
        v, nv = (np.array([o[i] for o in others], dtype=np.int64) for i in (0, 1))
        lengths = np.array([len(o[2]) for o in others], dtype=np.int64)
        tokens = np.concatenate([o[2] for o in others]) if others else np.zeros(0, dtype=np.int64)
        hit = hub[np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)] == tokens if others else np.zeros(0, dtype=bool)
        both = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64) if others else lengths
        need = -(-percent * (nu + nv) // (100 + percent))  # shingles that linked sets of these sizes share
        go = (both > 0) & (lengths - both <= nv - need) & ((len(hub) if others else 0) - both <= nu - need)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(go.sum()), u)), pa.array(v[go]), pa.array(np.full(int(go.sum()), nu)), pa.array(nv[go]), pa.array(both[go])], names=["u", "v", "nu", "nv", "both"])

    return run


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return _looked_up(rows, found, keys, stored)


def _fit(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, nu, nv) that are linked: partial overlaps by fragment, summed per pair. Pairs of one u are dealt over blocks."""
    pairs = stored(pairs)
    blocks = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("nv") / ELEMENTS)).cast("int")
    placed = looked_up(pairs, pairs.groupBy("u").agg(F.count("*").alias("n"), blocks.alias("blocks")), ["u"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    members = placed.select("u", "block", F.col("v").alias("node"), F.col("nv").alias("n"))
    hubs = placed.select("u", "block", F.col("u").alias("node"), F.col("nu").alias("n")).distinct()
    met = segments.join(small_or_not(stored(members.unionByName(hubs)), FEW_IDS), "node").select("u", "block", "node", "n", "fragment", "tokens")
    counted = met.groupBy("u", "block", "fragment").applyInArrow(_partial(percent), "u long, v long, nu long, nv long, both long")
    sums = counted.groupBy("u", "v", "nu", "nv").agg(F.sum("both").alias("both"))
    out = stored(sums.where(100 * F.col("both") >= percent * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v"))
    discard(pairs)
    return out


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, nu, nv, shared) less those that can't be linked: up to where the first of both prefixes ends, what isn't shared is missing for good."""
    need = f"(({percent} * (nu + nv) + {99 + percent}) div {100 + percent})"
    least = [F.expr(f"least({n} - ({n} * {percent} + 99) div 100 + 1, {n}) - ({n} - {need})") for n in ("nu", "nv")]
    return pairs.where(F.col("shared") >= F.least(*least)).select("u", "v", "nu", "nv")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, fragments: int = FRAGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    A text's set is its distinct k-word shingles over words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; with fewer words, the whole sequence as one. Texts are
    linked if 100 * intersection >= percent * union; component_id is the smallest id that links reach, itself included. No link is missed, but for shingles of equal 64-bit hashes.

    Null texts and texts without words have no shingles and no links. Rows without an id have no component_id unless they are linked with
    others, and come last; each row is a document, so repeated rows and rows with an equal id are linked by their texts alone. An empty table gives an empty table; other columns are not
    looked at. docs is read three times and must be a stored table, which gives its rows in one order; another order raises.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), key(id_col).alias("doc"))
    base = stored(texts.mapInArrow(_profile(k), _PROFILE))
    rows = base.where("block is null").select("row", "id", "doc", "n", "f1", "f2")
    own = rows.where("n > 0").groupBy("f1", "f2").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "row")).alias("one"))
    own = stored(own.select("f1", "f2", "copies", "one.doc", "one.row", F.monotonically_increasing_id().alias("node")))
    shared = spark.sparkContext.broadcast(_order(base, fragments))  # BUCKETS numbers

    one_each = lambda some: texts.select("text", "row").join(small_or_not(some, FEW_IDS), "row").select("text", "node", "f1")
    first = stored(one_each(own.select("row", "node", "f1")).mapInArrow(_in_order(shared, k, _prefixes(percent)), "node long, n long, prefix array<long>"))
    tokens = first.select("node", F.col("n").alias("size"), F.explode("prefix").alias("token"))
    tokens = stored(looked_up(tokens, tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), ["token"]))
    discard(first)
    # Of the shingles that the same sets have, one stands for all, with their number as its weight.
    same = tokens.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    same = same.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "n", "weight")
    groups = stored(looked_up(tokens, same, ["token"]))
    discard(tokens)
    wanted = stored(own.join(groups.select("node").distinct(), "node").select("row", "node", "f1"))
    segments = stored(one_each(wanted).mapInArrow(_in_order(shared, k, _segments), "node long, fragment int, tokens array<long>"))

    label = spark.createDataFrame([], "node long, component long")
    for r in range(ROUNDS):
        at = groups.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        hub = F.min_by(F.struct("node", "size", "component"), F.xxhash64(F.lit(r), "node")).alias("hub")
        mixed = at.groupBy("token").agg(F.count("*").alias("n"), hub, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token", "n", "hub")
        met = looked_up(at, mixed, ["token"]).where("component != hub.component").select(F.col("hub.node").alias("u"), F.col("node").alias("v"), F.col("hub.size").alias("nu"), F.col("size").alias("nv"), "weight")
        met = met.where(_fit("nu", "nv", percent)).groupBy("v", "nv", "u", "nu").agg(F.sum("weight").alias("weight"))
        met = met.groupBy("v", "nv").agg(F.max_by(F.struct("u", "nu"), F.struct("weight", F.xxhash64(F.lit(r), "u"))).alias("one")).select("one.*", "v", "nv")
        theirs = met.join(groups.select(F.col("node").alias("v"), "token", "weight"), "v").join(groups.select(F.col("node").alias("u"), "token"), ["u", "token"])
        met = theirs.groupBy("u", "v", "nu", "nv").agg(F.sum("weight").alias("shared"))
        links = _links(_promising(met, percent), segments, percent)
        if links.isEmpty():
            break
        label = stored(connected_components(links.unionByName(label.select(F.col("node").alias("u"), F.col("component").alias("v"))), stored))

    at = stored(groups.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = at.groupBy("token").agg(F.count("*").alias("n"), F.sum("size").alias("e"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    at = stored(looked_up(at, mixed.select("token", "n", "e", F.col("n").alias("m")), ["token"]))
    few = at.where(F.col("m") <= FEW_MEMBERS)
    other = few.select("token", F.col("node").alias("v"), F.col("size").alias("nv"), F.col("component").alias("c2"))
    met = few.join(other, "token").where("node < v and component != c2").select(F.col("node").alias("u"), "v", F.col("size").alias("nu"), "nv", "weight")
    met = met.where(_fit("nu", "nv", percent)).groupBy("u", "v", "nu", "nv").agg(F.sum("weight").alias("shared"))
    more = _links(_promising(met, percent), segments, percent)
    parts = F.greatest(F.ceil(F.col("e") / BLOCK_ELEMENTS), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("int")
    large = at.where(F.col("m") > FEW_MEMBERS).select("token", "node", "size", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    large = large.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", "node", "size", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), (F.col("own") > F.col("j")).cast("int").alias("side"))
    large = large.join(segments, "node").select("token", "a", "b", "node", "size", "side", "fragment", "tokens").groupBy("token", "a", "b").applyInArrow(_compare_blocks(percent), "u long, v long")
    more = stored(more.unionByName(large))
    if not more.isEmpty():
        label = stored(connected_components(more.unionByName(label.select(F.col("node").alias("u"), F.col("component").alias("v"))), stored))

    docs_of = label.join(own.select("node", "doc"), "node")
    least = docs_of.groupBy("component").agg(F.count("*").alias("n"), F.min("doc").alias("least"))
    placed = looked_up(docs_of.select("node", "component"), least, ["component"]).select("node", "least")
    placed = own.join(placed, "node", "left").select("f1", "f2", F.col("copies").alias("n"), F.coalesce("least", "doc").alias("component"))
    out = looked_up(rows.where("n > 0").drop("row").withColumnRenamed("n", "n_shingles"), placed, ["f1", "f2"]).select("id", "n_shingles", "component")
    out = out.unionByName(rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("doc").alias("component")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("component") == LAST, None).otherwise(F.col("component")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=80)
