"""Prefix tree of conversations: ternary search trees over range shards, merged where shards share a node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import staged

#: Turns that one row of a conversation holds at most; longer ones go on in further rows.
SEGMENT = 256
#: Turns of one shard, about.
SHARD_TURNS = 65_536
#: Parts of the join that gives children of shared nodes their parent's id, whose parents may be few.
SALTS = 32
#: Bytes of a turn's digest (the first half of a SHA-256), and of a text size.
DIGEST, SIZE = 16, 8


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (16 bytes of SHA-256 over role and text), size (UTF-8 bytes of the text); null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id is not null")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as pieces: rows of up to SEGMENT neighbouring turns of one conversation."""
    at = 0
    for b in batches:
        conv, part = b.column("conv_id").to_numpy(), b.column("part")
        digests, sizes = b"".join(b.column("digest").to_pylist()), b.column("size").to_numpy().astype("<i8").tobytes()
        cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
        bounds = [(lo, min(lo + SEGMENT, hi)) for first, hi in zip(cuts, cuts[1:], strict=False) for lo in range(first, hi, SEGMENT)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(conv[lo]) for lo, _ in bounds], pa.int64()),
                pa.array([part[lo].as_py() for lo, _ in bounds], pa.int32()),
                pa.array(range(at, at + len(bounds)), pa.int64()),
                pa.array([hi - lo for lo, hi in bounds], pa.int64()),
                pa.array([digests[DIGEST * lo : DIGEST * hi] for lo, hi in bounds], pa.binary()),
                pa.array([sizes[SIZE * lo : SIZE * hi] for lo, hi in bounds], pa.binary()),
            ],
            ["conv_id", "part", "place", "n", "digests", "sizes"],
        )
        at += len(bounds)


def pieces_of(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, start, n, digests, sizes: every conversation's turns in order, SEGMENT at most in a row, `start` turns before them.

    Turns are range-partitioned by conversation and place, so that a conversation of any length is spread over tasks;
    where one goes over several ranges only the counts of its pieces meet.
    """
    turns = turns_of(conversations)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    parts = max(1, -(-turns.count() // shard_turns))
    ranged = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    pieces = ranged.mapInArrow(_runs, "conv_id long, part int, place long, n long, digests binary, sizes binary")
    before = Window.partitionBy("conv_id").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv_id", "start", "n", "digests", "sizes")


def _cut(name: str, width: int, skip: Column, n: Column) -> Column:
    """`n` entries of a packed column after `skip` of them."""
    return F.substring(F.col(name), (skip * width + 1).cast("int"), (n * width).cast("int")).alias(name)


def _packed(name: str) -> Column:
    """The group's pieces put together in order of `start`; a group holds SEGMENT turns at most."""
    ordered = F.array_sort(F.collect_list(F.struct("start", name)))
    return F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x[name])).alias(name)


def with_shared_heads(pieces: DataFrame, group: int, head_turns: Column, most: int) -> DataFrame:
    """Pieces of rebuilt conversations: the first `head_turns` (of conv_id, `most` at most) turns of conversation c - c % group, then c's own after as many.

    A conversation without any turn left still has one piece, of none.
    """
    head = pieces.where((F.col("start") < most) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("first")).agg(_packed("digests"), _packed("sizes"))
    ids = pieces.where("start = 0").select("conv_id", head_turns.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("first"))
    none = F.lit(b"")
    heads = ids.join(head, "first", "left").select("conv_id", "h", F.coalesce("digests", none).alias("digests"), F.coalesce("sizes", none).alias("sizes"))
    heads = heads.withColumn("m", F.least("h", (F.octet_length("digests") / DIGEST).cast("long")))
    zero = F.lit(0).cast("long")
    first = heads.select("conv_id", zero.alias("start"), F.col("m").alias("n"), _cut("digests", DIGEST, zero, F.col("m")), _cut("sizes", SIZE, zero, F.col("m")))
    own = pieces.join(heads.select("conv_id", "h", "m"), "conv_id").where("start + n > h").withColumn("skip", F.greatest(zero, F.col("h") - F.col("start")))
    left = F.col("n") - F.col("skip")
    own = own.select("conv_id", (F.col("m") + F.col("start") + F.col("skip") - F.col("h")).alias("start"), left.alias("n"), _cut("digests", DIGEST, F.col("skip"), left), _cut("sizes", SIZE, F.col("skip"), left))
    return first.unionByName(own)


def segments_of(pieces: DataFrame, length: int = SEGMENT) -> DataFrame:
    """conv_id, seg, path, sizes, last, base, after: each conversation's turns number seg * length and on, `length` at most, as packed digests.

    `base` stands for all turns before the segment and `after` for those up to its end: equal for equal turns. They
    are 128 bits combined from hashes of whole segments with their numbers, so that a long conversation needs no chain.
    """
    last = F.greatest(F.col("start"), F.col("start") + F.col("n") - 1)
    p = pieces.withColumn("seg", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor(last / length))))
    skip = F.greatest(F.lit(0).cast("long"), F.col("seg") * length - F.col("start"))
    n = F.least(F.col("start") + F.col("n"), (F.col("seg") + 1) * length) - F.col("start") - skip
    p = p.select("conv_id", "seg", (F.col("start") + skip).alias("start"), _cut("digests", DIGEST, skip, n), _cut("sizes", SIZE, skip, n))
    rows = p.groupBy("conv_id", "seg").agg(_packed("digests"), _packed("sizes")).withColumnRenamed("digests", "path")
    sha = F.sha2("path", 256)
    rows = rows.withColumn("x", F.xxhash64("seg", F.substring(sha, 1, 32))).withColumn("y", F.xxhash64("seg", F.substring(sha, 33, 32)))
    w = Window.partitionBy("conv_id").orderBy("seg")
    mark = lambda frame: F.concat(*[F.lpad(F.hex(F.bit_xor(c).over(frame)), 16, "0") for c in ("x", "y")])
    before = F.when(F.col("seg") == 0, F.lit("")).otherwise(mark(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.select("conv_id", "seg", "path", "sizes", F.lead("seg").over(w).isNull().alias("last"), before.alias("base"), mark(w.rowsBetween(Window.unboundedPreceding, 0)).alias("after"))


class TernaryTree:
    """A ternary search tree of code sequences; each of its nodes is one prefix. Node 0 is the empty prefix.

    `up` is the node one turn shorter. A node is made after the one it hangs from, so going through nodes from the last
    to the first meets children before parents.
    """

    def __init__(self) -> None:
        self.code, self.less, self.more, self.down = [-1], [0], [0], [0]
        self.up, self.depth, self.via = [-1], [0], [0]

    def _new(self, code: int, up: int, via: int) -> int:
        for column, value in ((self.code, code), (self.less, 0), (self.more, 0), (self.down, 0), (self.up, up), (self.depth, self.depth[up] + 1), (self.via, via)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], via: int) -> int:
        """The node of the whole sequence; new nodes remember that they came `via` it."""
        node = 0
        for c in codes:
            at = self.down[node]
            if not at:
                at = self.down[node] = self._new(c, node, via)
            while self.code[at] != c:
                side = self.less if c < self.code[at] else self.more
                if not side[at]:
                    side[at] = self._new(c, node, via)
                at = side[at]
            node = at
        return node


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, each range's middle before its halves: sorted sequences inserted so give balanced trees."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


_NODE = "shared boolean, key string, parent_key string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, ends string, ends_sha256 string"
_NODE_ARROW = pa.schema([("shared", pa.bool_()), *[(c, pa.string()) for c in ("key", "parent_key")], *[(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "size")], ("ends", pa.string()), ("ends_sha256", pa.string())])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _tree_nodes(rows: list[dict], first: bool, last: bool, length: int) -> Iterator[dict]:
    """Nodes of the sorted segments `rows` that share one base. `first`, `last`: whether they begin or end the shard.

    A node is shared when another shard or segment may hold it too: the base itself, what the shard's first and last
    segments run through, and what a conversation that goes on in a further segment runs through. All others are whole.
    """
    base, top = rows[0]["base"], rows[0]["seg"] * length
    distinct: list[int] = [i for i in range(len(rows)) if i == 0 or rows[i]["path"] != rows[i - 1]["path"]]
    ends = [*distinct[1:], len(rows)]
    split = [[r[i : i + DIGEST] for i in range(0, len(r), DIGEST)] for r in (rows[i]["path"] for i in distinct)]
    codes = {d: i for i, d in enumerate(sorted({d for s in split for d in s}))}
    tree, whole = TernaryTree(), [0] * len(distinct)
    for i in medians(len(distinct)):
        whole[i] = tree.insert([codes[d] for d in split[i]], i)
    n = len(tree.code)
    members, least, stops, keys = [0] * n, [None] * n, [None] * n, [None] * n
    shared = [False] * n
    for i, node in enumerate(whole):
        group = rows[distinct[i] : ends[i]]
        members[node] += len(group)
        least[node] = group[0]["conv_id"]
        stops[node] = [r["conv_id"] for r in group if r["last"]]
        if len(stops[node]) < len(group) or first and i == 0 or last and i == len(whole) - 1:
            at = node
            while at > 0 and not shared[at]:
                shared[at] = True
                at = tree.up[at]
    shared[0] = True
    for v in range(n - 1, 0, -1):
        u = tree.up[v]
        members[u] += members[v]
        least[u] = least[v] if least[u] is None else min(least[u], least[v])
    if top:  # counted where the segment before ends
        members[0], least[0] = 0, None
    sizes = [np.frombuffer(rows[i]["sizes"], "<i8") for i in distinct]
    children, leaves, saved, own = [0] * n, [0] * n, [0] * n, [0] * n
    for v in range(n - 1, -1, -1):
        if v:
            own[v] = int(sizes[tree.via[v]][tree.depth[v] - 1])
        if not shared[v]:
            leaves[v] += not children[v]
            saved[v] += (members[v] - 1) * own[v]
        if v and not shared[v]:
            u = tree.up[v]
            children[u] += 1
            leaves[u] += leaves[v]
            saved[u] += saved[v]
        if shared[v]:
            i, d = tree.via[v], tree.depth[v]
            if d == 0:
                keys[v] = base
            elif d == length:
                keys[v] = rows[distinct[i]]["after"]
            else:
                keys[v] = hashlib.sha256(base.encode() + rows[distinct[i]]["path"][: DIGEST * d]).hexdigest()[:32]
    for v in range(n):
        u, ids = tree.up[v], ",".join(map(str, sorted(stops[v] or ())))
        yield {
            "shared": shared[v], "key": keys[v], "parent_key": keys[u] if v and shared[u] else None, "depth": top + tree.depth[v], "conv_id": least[v], "parent_conv_id": None if v == 0 or shared[u] else least[u], "n_convs": members[v],
            "n_children": children[v], "n_leaves": leaves[v], "saved": saved[v], "size": own[v] if v else None, "ends": ids if shared[v] and ids else None, "ends_sha256": None if shared[v] else hashlib.sha256(ids.encode()).hexdigest() if ids else _NO_ENDS,
        }


def _shard_nodes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a range partition is a shard of bounded size, so its rows may be held at once
        rows = [r for b in batches for r in b.to_pylist()]
        cuts = [i for i in range(len(rows)) if i == 0 or rows[i]["base"] != rows[i - 1]["base"]] + [len(rows)]
        out: list[dict] = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for node in _tree_nodes(rows[lo:hi], lo == 0, hi == len(rows), length):
                out.append(node)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, _NODE_ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _NODE_ARROW)

    return run


def _digests_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's comma-joined chunks, which come sorted: only the state of one digest is held."""
    key, state = None, None
    for b in batches:
        keys, found = [], []
        for k, chunk in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k == key:
                state.update(b"," + chunk.encode())
                continue
            if state is not None:
                keys.append(key)
                found.append(state.hexdigest())
            key, state = k, hashlib.sha256(chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and each node's `values` summed over its subtree, for nodes (key, parent_key, *values), where '' is the root's key.

    Each round adds the sums of the nodes that point at one and lets every node point twice as far, so as many rounds
    are needed as the depth has binary digits. The root's sums are those of the whole table and take no part.
    """
    root = nodes.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]).select(F.lit("").alias("key"), *values)
    t = staged(nodes.where("key != ''").select("key", F.expr("nullif(parent_key, '')").alias("far"), *values), "trie-sums")
    while not t.where("far is not null").isEmpty():
        add = t.where("far is not null").groupBy(F.col("far").alias("key")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        further = t.where("far is not null").select(F.col("key").alias("far"), F.col("far").alias("_far"))
        summed = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        t = staged(t.join(add, "key", "left").join(further, "far", "left").select("key", F.col("_far").alias("far"), *summed), "trie-sums")
    return t.select("key", *values).unionByName(root)


def prefix_trie(rebuilt: DataFrame, shard_turns: int = SHARD_TURNS, length: int = SEGMENT) -> DataFrame:
    """The prefix tree of conversations given as pieces (conv_id, start, n, digests, sizes): one row for each distinct prefix.

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations, cut into segments, are range-partitioned by their turns in lexicographic order and then by id, so a
    prefix shared by a third of all conversations, or copies of one, are spread over shards. A shard numbers its turns
    by a dictionary and inserts its sequences, medians first, into a ternary search tree; members, leaves and savings
    are summed from the deepest nodes up. Nodes that other shards may hold too are merged by key: counts add up, sums
    go up the merged nodes in rounds that double their reach, and the ids that end at a node are digested in order,
    chunk by chunk. An empty table gives an empty table.
    """
    segments = staged(segments_of(rebuilt, length), "trie-segments")
    turns = segments.agg(F.coalesce(F.sum(F.octet_length("path") / DIGEST + 1), F.lit(0))).first()[0]
    order = ["base", "path", "conv_id"]
    ranged = segments.repartitionByRange(max(1, int(-(-turns // shard_turns))), *order).sortWithinPartitions(*order)
    nodes = staged(ranged.mapInArrow(_shard_nodes(length), _NODE), "trie-nodes")

    parts = nodes.where("shared")
    merged = parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("size").alias("size"))
    merged = staged(merged, "trie-shared")
    under = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(under, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    merged = merged.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.coalesce("size", F.lit(0)))
    sums = _subtree_sums(merged, ["n_leaves", "saved"])
    chunks = parts.where("ends is not null").select("key", F.substring_index("ends", ",", 1).cast("long").alias("at"), "ends")
    digests = chunks.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_digests_of_ends, "key string, ends_sha256 string")
    merged = merged.drop("n_leaves", "saved", "more", "size").join(sums, "key").join(digests, "key", "left")
    merged = staged(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))), "trie-merged")

    # a few shared nodes may have most of the others for children: their ids go to every part of the join
    ids = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    open_ = nodes.where("not shared and parent_key is not null").unionByName(merged, allowMissingColumns=True)
    salt = F.pmod(F.xxhash64("conv_id", "depth", "n_convs", "ends_sha256"), F.lit(SALTS)).cast("int")
    found = open_.withColumn("salt", salt).join(ids, ["parent_key", "salt"], "left").withColumn("parent_conv_id", F.col("found"))
    out = nodes.where("not shared and parent_key is null").select(cols).unionByName(found.select(cols))
    return out.withColumnRenamed("saved", "saved_tokens")


def conversation_trie(conversations: DataFrame, group: int = 5, spread: int = 9, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix tree of `conversations` (conv_id, turn, role, text; others ignored), rebuilt so that neighbours share their beginnings.

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(decimal c) % spread, and then its own
    after as many (the remainder of a negative c is negative, as in SQL). Turns are in order of `turn`, null first, and equal ones in order of their digests; null role and
    text are empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left
    out. Long texts are only digested, long conversations cut into segments. An empty table gives an empty table.
    """
    pieces = staged(pieces_of(conversations, shard_turns), "trie-pieces")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    return prefix_trie(with_shared_heads(pieces, group, h, spread - 1), shard_turns)
