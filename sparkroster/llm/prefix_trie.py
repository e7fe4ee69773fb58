"""The prefix trie of conversations, from sorted neighbours and their longest common prefixes.

Conversations are cut into blocks of turns; a block is known by a hash of all turns before it, so blocks of one
start are a trie of their own, whose rows have bounded length. Equal blocks are one row with a count. The rows
are sorted over the cluster; in a piece of them, edges between neighbours are united in descending order of
their common prefix, and every merge is a branching node. A node that reaches the border of a piece is open:
pieces give their open nodes with what hangs below, and these few are merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SMALL_LIST, unite
from .common import materialised, ragged

BLOCK_TURNS = 512
#: Rows of a conversation that one task may number.
HOT_TURNS = 10_000
FAMILY, HEADS = 100, 6
IDS_A_ROW = 4096
NODE = (
    "q1 long, q2 long, block int, place int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, "
    "parent_conv long, p1 long, p2 long, open boolean, path array<long>"
)


def _pairs_equal(z: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many leading rows of `z` from `a` and from `b` on are alike, `sizes` at most."""
    if not len(sizes) or not sizes.any():
        return np.zeros(len(sizes), np.int64)
    at = ragged(np.zeros(len(sizes), np.int64), sizes)
    same = (z[ragged(a, sizes)] == z[ragged(b, sizes)]).all(axis=1)
    unlike = np.where(same, np.iinfo(np.int64).max, at)
    some = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.int64)
    out[some] = np.minimum.reduceat(unlike, (np.cumsum(sizes) - sizes)[some])
    return np.minimum(out, sizes)


class Forest:
    """The tries of sorted distinct rows: `block`, the hash of all turns before it, turns as pairs of hashes with
    their lengths, and how many conversations there are and the smallest of them."""

    def __init__(self, rows: pa.RecordBatch, block_turns: int) -> None:
        self.block_turns = block_turns
        self.block = rows.column("block").to_numpy()
        self.start = np.stack([rows.column(c).to_numpy() for c in ("p1", "p2")], axis=1)
        turns, chars = rows.column("turns"), rows.column("chars")
        z = turns.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        self.sizes = np.diff(turns.offsets.to_numpy()).astype(np.int64) // 2
        self.first = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.concatenate([np.zeros((1, 2), np.int64), np.bitwise_xor.accumulate(z, axis=0)]) if len(z) else np.zeros((1, 2), np.int64)
        self.chars = np.r_[0, np.cumsum(chars.flatten().to_numpy(zero_copy_only=False).astype(np.int64))]
        self.n, self.conv = rows.column("n").to_numpy().copy(), rows.column("conv").to_numpy().copy()
        same = (self.block[1:] == self.block[:-1]) & (self.start[1:] == self.start[:-1]).all(axis=1)
        shared = _pairs_equal(z, self.first[:-1], self.first[1:], np.minimum(self.sizes[:-1], self.sizes[1:]))
        self.shared = np.where(same, shared, -1)

    def hash_at(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = self.first[row]
        return self.start[row] ^ self.hashes[at] ^ self.hashes[at + place]

    def chars_to(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.chars[self.first[row] + place] - self.chars[self.first[row]]

    def nodes(self) -> pa.RecordBatch:
        m = len(self.n)
        comp, top = np.arange(m), self.sizes.copy()
        open_ = np.zeros(m, bool)
        open_[[0, m - 1]] = True
        kids, saved = np.zeros(m, np.int64), np.zeros(m, np.int64)
        # What open nodes add themselves is known only when their pieces are merged.
        leaves = np.where(open_, 0, 1)
        chains: list[tuple[np.ndarray, ...]] = []

        def chain(of: np.ndarray, low: int, parent: np.ndarray, known: np.ndarray) -> None:
            chains.append(tuple(np.asarray(x) for x in (of, np.full(len(of), low), top[of], self.n[of], self.conv[of], kids[of], leaves[of], saved[of], open_[of], parent, known)))

        def carried(of: np.ndarray, low: int) -> np.ndarray:
            own = (self.n[of] - 1) * (self.chars_to(of, top[of]) - self.chars_to(of, np.full(len(of), low)))
            return saved[of] + np.where(open_[of], 0, own)

        for depth in np.unique(self.shared[self.shared >= 0])[::-1].tolist():
            edge = np.flatnonzero(self.shared == depth)
            old = np.unique(np.r_[comp[edge], comp[edge + 1]])
            comp = unite(comp, edge, edge + 1)
            merged, at = np.unique(comp[old], return_inverse=True)
            below = top[old] > depth
            child, child_at = old[below], at[below]
            n, k, lv, sv = (np.zeros(len(merged), np.int64) for _ in range(4))
            low = np.full(len(merged), np.iinfo(np.int64).max)
            touches = np.zeros(len(merged), bool)
            np.add.at(n, at, self.n[old])
            np.minimum.at(low, at, self.conv[old])
            np.logical_or.at(touches, at, open_[old])
            np.add.at(k, child_at, ~open_[child])
            np.add.at(lv, child_at, leaves[child])
            np.add.at(sv, child_at, carried(child, depth))
            chain(child, depth, low[child_at], ~touches[child_at] & (depth > 0))
            self.n[merged], self.conv[merged], kids[merged], leaves[merged], saved[merged] = n, low, k, lv, sv
            top[merged], open_[merged] = depth, touches
        trees = np.unique(comp)
        long = trees[top[trees] > 0]
        sums = carried(long, 0)
        chain(long, 0, np.zeros(len(long), np.int64), np.zeros(len(long), bool))
        kids[long], saved[long], top[long] = np.where(open_[long], 0, 1), sums, 0
        return self._rows(trees, (kids, leaves, saved, open_), chains)

    def _rows(self, trees: np.ndarray, of_tree: tuple[np.ndarray, ...], chains: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, low, high, n, conv, kids, leaves, saved, open_, parent, known = (np.concatenate(c) for c in zip(*chains, strict=True))
        sizes = high - low
        of, place = np.repeat(np.arange(len(row)), sizes), ragged(low + 1, sizes)
        row, last = row[of], place == high[of]
        open_, n = open_[of], n[of]
        chars = self.chars_to(row, place) - self.chars_to(row, place - 1)
        own = np.where(open_, 0, (n - 1) * (self.chars_to(row, high[of]) - self.chars_to(row, place - 1)))
        inner = place > low[of] + 1
        columns = [
            (row, trees), (place, 0 * trees), (conv[of], self.conv[trees]), (n, self.n[trees]),
            (np.where(last, kids[of], ~open_), of_tree[0][trees]), (leaves[of], of_tree[1][trees]),
            (saved[of] + own, of_tree[2][trees]), (chars, 0 * trees), (np.where(inner, conv[of], parent[of]), 0 * trees),
            (np.where(inner, ~open_, known[of]), np.zeros(len(trees), bool)), (open_, of_tree[3][trees]),
        ]
        row, place, conv, n, kids, leaves, saved, chars, parent, known, open_ = (np.concatenate(c) for c in columns)
        own_hash, above = self.hash_at(row, place), self.hash_at(row, np.maximum(place - 1, 0))
        named = open_ | (place == self.block_turns)
        some = np.flatnonzero(named)
        steps = np.where(named, place, 0)
        path = self.hash_at(np.repeat(row[some], place[some]), ragged(0 * some, place[some])).reshape(-1)
        paths = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * steps)].astype(np.int32)), pa.array(path))
        out = [
            own_hash[:, 0], own_hash[:, 1], self.block[row], place.astype(np.int32), conv, n, kids, leaves, saved, chars,
            pa.array(parent, mask=~known), above[:, 0], above[:, 1], pa.array(open_), paths,
        ]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in out], names=[c.split()[0] for c in NODE.split(", ")])


def _forests(block_turns: int):
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield Forest(batch, block_turns).nodes()

    return forests


def numbered(turns: DataFrame, counts: DataFrame) -> DataFrame:
    """`turns(conv_id, turn, t1, t2, chars)` with `pos`, from 1 on in order of turn (null first) and of a hash.

    Conversations of over `HOT_TURNS` turns are dealt out by ranges of that order and numbered within a range;
    the counts of the ranges before give the offsets, so no task gets such a conversation whole."""
    order = [F.col("turn").asc_nulls_first(), "t1", "t2"]
    within = Window.partitionBy("conv_id").orderBy(*order)
    hot = materialised(counts.where(F.col("n") > HOT_TURNS).select("conv_id"), "hot-conversations")
    n_hot = hot.count()
    if not n_hot:
        return turns.withColumn("pos", F.row_number().over(within).cast("long"))
    listed = F.broadcast(hot) if n_hot <= SMALL_LIST else hot
    small = turns.join(listed, "conv_id", "left_anti").withColumn("pos", F.row_number().over(within).cast("long"))
    # Rows alike in all else are told apart by a running number, so that they too can be dealt out.
    dealt = turns.join(listed, "conv_id", "left_semi").withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("conv_id", *order, "_row").withColumn("_range", F.spark_partition_id())
    dealt = materialised(dealt, "ranges")
    at = ["conv_id", "_range"]
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy(at).count().select(*at, F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(at).orderBy(*order, "_row"))
    large = dealt.withColumn("_n", number).join(offsets, at).withColumn("pos", F.col("_before") + F.col("_n"))
    return small.unionByName(large.select(*small.columns))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, `conv_id, depth, t1, t2, chars`, and `conv_id, total` of each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"), F.length(text).cast("long").alias("chars"),
    )
    counts = materialised(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    rows = materialised(numbered(turns, counts).drop("turn"), "numbered-turns")
    digits = F.col("conv_id").cast("string").cast("binary")
    info = counts.withColumns({"h": F.crc32(digits) % HEADS, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    entry = F.struct("pos", "t1", "t2", "chars")
    is_base = (F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)
    heads = rows.where(is_base).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(entry).alias("head"))
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,chars:bigint>>")), lambda t: t["pos"] <= F.col("h"))
    info = info.join(heads, "base", "left").withColumn("head", head).withColumn("given", F.size("head"))
    info = materialised(info.withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    given = info.select("conv_id", F.inline("head")).withColumnRenamed("pos", "depth")
    own = rows.join(info.select("conv_id", "h", "given"), "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "t1", "t2", "chars")
    return given.unionByName(own), info.select("conv_id", "total")


def blocks_of(turns: DataFrame, totals: DataFrame, block_turns: int) -> DataFrame:
    """`conv_id, block, p1, p2, turns, chars, ends, q1, q2`: the turns of a conversation in blocks, with a hash of the turns
    before the block and, as q, to its end. The hash is the exclusive or of hashes of every (depth, turn)."""
    block = F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / block_turns).cast("int").alias("block")
    # A row of depth 0 marks the block that a conversation ends in, its only one if it has no turns.
    zero = F.lit(0).cast("long")
    last = F.floor((F.greatest(F.col("total"), F.lit(1)) - 1) / block_turns).cast("int").alias("block")
    marks = totals.select("conv_id", last, zero.alias("depth"), zero.alias("z1"), zero.alias("z2"), zero.alias("chars"))
    z1, z2 = F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit("second"), "t2", "t1", "depth")
    rows = turns.select("conv_id", block, "depth", z1.alias("z1"), z2.alias("z2"), "chars").unionByName(marks)
    grouped = rows.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("depth", "z1", "z2", "chars"))).alias("t"),
        F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), (F.min("depth") == 0).alias("ends"),
    )
    real = F.filter("t", lambda t: t["depth"] > 0)
    hashes = F.flatten(F.transform(real, lambda t: F.array(t["z1"], t["z2"]))).alias("turns")
    rows = grouped.select("conv_id", "block", "x1", "x2", "ends", hashes, F.transform(real, lambda t: t["chars"]).alias("chars"))
    rows = materialised(rows, "turn-blocks")
    alone = (F.col("block") == 0) & F.col("ends")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.where(~alone).select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(before), zero).alias(p) for x, p in (("x1", "p1"), ("x2", "p2"))])
    placed = rows.where(~alone).join(starts, ["conv_id", "block"]).unionByName(rows.where(alone).withColumns({"p1": zero, "p2": zero}))
    return placed.select("conv_id", "block", "p1", "p2", "turns", "chars", "ends", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _above(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` once for every node above theirs in the block, with its `q1, q2, place`."""
    spread = rows.select("path", *columns, F.explode(_steps((F.size("path") / 2).cast("int"))).alias("place"))
    return spread.select(F.col("path")[2 * F.col("place")].alias("q1"), F.col("path")[2 * F.col("place") + 1].alias("q2"), "place", *columns)


def merged_open(nodes: DataFrame) -> DataFrame:
    """The open nodes of all pieces, put together. Sums of pieces hold what hangs closed below a node; what open
    nodes add themselves goes to all (open) nodes above them."""
    key = ["block", "place", "q1", "q2"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    same = [F.first(c).alias(c) for c in ("p1", "p2", "path")]
    merged = materialised(nodes.where("open").groupBy(key).agg(F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), *sums, *same), "open-nodes")
    kids = merged.where("place > 0").groupBy("block", (F.col("place") - 1).alias("place"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(F.count("*").alias("_kids"))
    merged = merged.join(kids, key, "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_kids")
    own = merged.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "left": (F.col("n_convs") - 1) * F.col("chars")})
    own = materialised(own, "own-parts")
    parts = _above(own, "block", "leaf", "left").unionByName(own.select("q1", "q2", "place", "block", "leaf", "left"))
    parts = parts.groupBy(key).agg(F.sum("leaf").alias("_leaves"), F.sum("left").alias("_saved"))
    done = own.join(parts, key).withColumns({"n_leaves": F.col("n_leaves") + F.col("_leaves"), "saved": F.col("saved") + F.col("_saved")})
    return materialised(done.withColumn("parent_conv", F.lit(None).cast("long")).drop("leaf", "left", "_leaves", "_saved"), "merged-nodes")


def _over_blocks(nodes: DataFrame, block_turns: int) -> DataFrame:
    """`nodes` with what hangs in later blocks added: the trie of a later block hangs below the last turn of the
    block before. Its sums go up by doubled steps, so rounds grow with the logarithm of the number of blocks."""
    trees = nodes.where("place = 0 AND block > 0").select("q1", "q2", "block", F.col("n_children").alias("_kids"), (F.col("n_leaves") - 1).alias("leaf"), F.col("saved").alias("left"))
    ends = nodes.where(F.col("place") == block_turns).select("q1", "q2", "path")
    trees = materialised(trees.join(ends, ["q1", "q2"]), "later-blocks")
    up = [F.when(F.col("block") > 1, F.col("path")[i]).alias(c) for i, c in enumerate(("u1", "u2"))]
    sums = trees.select("q1", "q2", "leaf", "left", *up)
    while not sums.where("u1 IS NOT NULL").isEmpty():
        added = sums.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("q1"), F.col("u2").alias("q2")).agg(F.sum("leaf").alias("_leaf"), F.sum("left").alias("_left"))
        further = sums.select(F.col("q1").alias("u1"), F.col("q2").alias("u2"), F.col("u1").alias("_u1"), F.col("u2").alias("_u2"))
        moved = sums.join(added, ["q1", "q2"], "left").join(further, ["u1", "u2"], "left")
        total = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaf", "left")]
        sums = materialised(moved.select("q1", "q2", *total, F.col("_u1").alias("u1"), F.col("_u2").alias("u2")), "block-sums")
    trees = trees.drop("leaf", "left").join(sums.select("q1", "q2", "leaf", "left"), ["q1", "q2"])
    columns = ["q1", "q2", "leaf", "left", "_kids"]
    parts = _above(trees.drop("q1", "q2"), "leaf", "left").withColumn("_kids", F.lit(0).cast("long")).select(columns)
    parts = parts.unionByName(trees.select(columns)).groupBy("q1", "q2").agg(*[F.sum(c).alias(c) for c in columns[2:]])
    nodes = nodes.where("place > 0 OR block = 0").join(parts, ["q1", "q2"], "left")
    more = {"n_leaves": "leaf", "saved": "left", "n_children": "_kids"}
    return nodes.withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in more.items()}).drop(*more.values())


def _digests(ends: DataFrame) -> DataFrame:
    """`q1, q2, ends_sha256` of `ends(q1, q2, conv_id)`: ids in ascending order, joined by commas. The ids are sorted over
    the cluster and written as texts of up to `IDS_A_ROW` ids; a node's texts then pass one after the other."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q1, q2, ids = (batch.column(c).to_numpy() for c in ("q1", "q2", "conv_id"))
            new = np.flatnonzero(np.r_[True, (q1[1:] != q1[:-1]) | (q2[1:] != q2[:-1])]) if len(ids) else np.empty(0, np.int64)
            cuts = [c for a, b in zip(new, [*new[1:], len(ids)], strict=True) for c in range(a, b, IDS_A_ROW)]
            joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(q1[cuts]), pa.array(q2[cuts]), pa.array(ids[cuts]), pa.array(joined, pa.string())], names=["q1", "q2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for q1, q2, ids in zip(*(batch.column(c).to_pylist() for c in ("q1", "q2", "ids")), strict=True):
                if (q1, q2) != key:
                    if running is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = (q1, q2), hashlib.sha256(ids.encode())
                else:
                    running.update(f",{ids}".encode())
            yield _digest_rows(done)
        if running is not None:
            yield _digest_rows([(*key, running.hexdigest())])

    rows = ends.repartitionByRange("q1", "q2", "conv_id").sortWithinPartitions("q1", "q2", "conv_id")
    rows = rows.mapInArrow(texts, "q1 long, q2 long, first long, ids string")
    rows = rows.repartition("q1", "q2").sortWithinPartitions("q1", "q2", "first")
    return rows.mapInArrow(digests, "q1 long, q2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    q1, q2, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q1, pa.int64()), pa.array(q2, pa.int64()), pa.array(digest, pa.string())], names=["q1", "q2", "ends_sha256"])


def prefix_trie(turns: DataFrame, totals: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for every node of the trie of `turns(conv_id, depth, t1, t2, chars)`, turns known by a 128-bit hash, of the
    conversations of `totals(conv_id, total)`, `total` their number of turns. For the columns see `trie_report`."""
    blocks = materialised(blocks_of(turns, totals, block_turns), "placed-blocks")
    strings = blocks.groupBy("block", "p1", "p2", "turns", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    order = ["block", "p1", "p2", "turns"]
    pieces = strings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_forests(block_turns), NODE)
    pieces = materialised(pieces, "pieces")
    opened = merged_open(pieces)
    columns = ["q1", "q2", "block", "place", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "parent_conv", "p1", "p2", "path"]
    nodes = pieces.where("NOT open").select(columns).unionByName(opened.select(columns))
    targets = opened
    first = blocks.agg(F.max("block").alias("block"), F.min("conv_id").alias("conv")).first()
    if first["block"]:
        nodes = materialised(_over_blocks(nodes, block_turns), "all-nodes")
        targets = nodes.where((F.col("place") == block_turns) | (F.col("path").isNotNull() & (F.size("path") > 0)))
    # A node's parent is known within its piece, or is the root, or is one of the few that were merged.
    depth = F.col("block").cast("long") * block_turns + F.col("place")
    nodes = nodes.drop("path").withColumn("depth", depth)
    targets = materialised(targets.where("place > 0").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("conv_id").alias("_conv")), "parents")
    n_targets = targets.count()
    nodes = nodes.join(F.broadcast(targets) if n_targets <= SMALL_LIST else targets, ["p1", "p2"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(first["conv"]).cast("long")).when(F.col("depth") > 1, F.coalesce("parent_conv", "_conv"))
    ends = _digests(blocks.where("ends").select("q1", "q2", "conv_id"))
    nodes = nodes.join(ends, ["q1", "q2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def trie_report(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """`conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256` of every node of the trie of the
    rebuilt conversations of `conversations(conv_id, turn, role, text, ...)`.

    Turns stand in order of `turn`, null first, turns of one number in order of a hash of role and text;
    repeated rows are turns like any other. Null roles and texts are empty; rows without conversation id are
    left out. A conversation starts with the first turns of the first one of its hundred. Turns are one if
    128 bits of hashes of role and text agree, so very long texts cost their hash alone. Other columns are
    ignored; an empty table gives no nodes.

    A node's `conv_id` is the smallest of its members, which with the depth names it; `saved_tokens` sums
    (members - 1) times the code points of the last text over the subtree.
    """
    if block_turns < HEADS:
        raise ValueError(f"a block must hold the {HEADS - 1} turns that a conversation may be given")
    return prefix_trie(*rebuilt(conversations), block_turns)
