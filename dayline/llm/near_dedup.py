"""Near-duplicate documents by HyperMinHash sketches, banding and verification on full shingle sets.

A document's set holds its distinct five-word shingles. A sketch has 128 registers: a shingle's 64-bit hash picks a
register with seven bits, and of the smallest remainder the register keeps the count of leading zeros and the ten bits
after the leading one (16 bits in all, 0 for an empty register). For banding, an empty register borrows the value of
a full one by a fixed order of its own, so that bands of small sets are as selective as those of large ones. Bands of
four registers propose pairs, the registers of a pair give a Jaccard estimate corrected for chance collisions, and pairs
that may reach the threshold are verified on the full sets, which travel once for each group of comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayline.llm.common import WordHash, semi_join, small_batches, staged, words
from dayline.llm.components import connected_components

REGISTERS, PICK_BITS, MANTISSA, BANDS = 128, 7, 10, 32
#: Registers of the finer sketches that screen pairs within a task (2 ** FINE_BITS).
FINE_BITS = 9
#: Members of a block, and shingles of all its members, in the mean at most.
BLOCK, BLOCK_SHINGLES = 512, 500_000
SHINGLE = 5
#: Odd multipliers that make a shingle's hash depend on the order of its words.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: For each register the order in which it looks for a full one.
_BORROW = np.argsort(np.random.Generator(np.random.PCG64(1)).random((REGISTERS, REGISTERS)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence is one when it has fewer than five words."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, ws)), dtype=np.uint64)
    n = len(h) - SHINGLE + 1
    if n < 1:
        return _mixed((h * _ODD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    s = h[:n] * _ODD[0]
    for j in range(1, SHINGLE):
        s += h[j : j + n] * _ODD[j]
    s = np.sort(_mixed(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def registers(shingles: np.ndarray, pick_bits: int = PICK_BITS) -> np.ndarray:
    """The 2 ** pick_bits compressed registers of a sorted set."""
    out = np.zeros(1 << pick_bits, np.uint16)
    if not len(shingles):
        return out
    picks = (shingles >> np.uint64(64 - pick_bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, picks[1:] != picks[:-1]])  # the set is sorted: the first of a register is its least
    rest = (shingles[first] << np.uint64(pick_bits)) >> np.uint64(11)  # 53 bits, exact as doubles
    fraction, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest > 0, 53 - exponent, 53)
    mantissa = np.where(rest > 0, ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    out[picks[first]] = ((zeros + 1) << MANTISSA) | mantissa
    return out


def band_keys(r: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of a filled sketch; its last five bits are the band's number."""
    full = r > 0
    dense = r.copy()
    empty = np.flatnonzero(~full)
    if len(empty):
        dense[empty] = r[_BORROW[empty, full[_BORROW[empty]].argmax(axis=1)]]
    band = np.arange(BANDS, dtype=np.uint64)
    return ((_mixed(dense.view(np.uint64) * _ODD[0] + band * _ODD[1]) & ~np.uint64(BANDS - 1)) | band).view(np.int64)


def narrowed(r: np.ndarray) -> np.ndarray:
    """Registers in a byte: up to fifteen for the leading zeros, and the first four bits of the mantissa."""
    return np.where(r > 0, (np.minimum(r >> MANTISSA, 15) << 4) | ((r >> (MANTISSA - 4)) & 15), 0).astype(np.uint8)


def may_reach(same: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray, least: float, mantissa: int = MANTISSA) -> np.ndarray:
    """Whether sets of sizes n and m can have a Jaccard similarity of `least`, as far as their registers tell.

    Of the `filled` registers that either set fills, the `same` ones estimate J plus chance matches; with equal sizes a
    register pair collides with probability 0.1699 / 2**mantissa, less with unequal ones (published approximation). The
    corrected estimate may fall short by five standard errors of a sample of `filled` out of the union's shingles.
    """
    small, large = np.maximum(np.minimum(n, m), 1), np.maximum(n, m)
    ratio, filled = large / small, np.maximum(filled, 1)
    chance = 0.169919487159739 / (1 << mantissa) * 4 * ratio / (1 + ratio) ** 2
    estimate = (same / filled - chance) / (1 - chance)
    union = np.maximum((n + m) / (1 + least), filled)
    error = np.sqrt(least * (1 - least) / filled * (1 - filled / union)) + 0.5 / filled
    return (estimate + 5 * error >= least) & (small >= least * large)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in batches:
        size, mark, sig, keys = [], [], [], []
        for text in b.column(1):
            s = shingle_set(text.as_py(), hashes)
            r = registers(s) if len(s) else None
            size.append(len(s))
            mark.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(r.tobytes() if len(s) else None)
            if len(s):
                keys.append(band_keys(r))
        at = np.cumsum([0, *(BANDS * (n > 0) for n in size)])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary()), lists], ["doc_id", "n_shingles", "mark", "sig", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            s = b.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array([shingle_set(t.as_py(), hashes).tobytes() for t in s.column(1)], pa.binary())], ["id", "shingles"])


def _hopeful(percent: int):
    """Pairs (id, hub) whose registers leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig", "hub_sig"))
            n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "hub_n"))
            keep = may_reach(((x == y) & (x > 0)).sum(axis=1), ((x > 0) | (y > 0)).sum(axis=1), n, m, percent / 100)
            yield b.select(["id", "hub", "n"]).filter(pa.array(keep))

    return run


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set `one` each of `others` (none empty) holds."""
    if not others:
        return np.empty(0, np.int64)
    flat = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(found, np.r_[0, np.cumsum([len(o) for o in others])[:-1]], dtype=np.int64)


def _sets_in(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]


def _star(percent: int):
    """Links (a, b) of a hub with the members of its group, on full sets."""

    def run(t: pa.Table) -> pa.Table:
        ids, hub, sets = t.column("id").to_numpy(), t.column("hub")[0].as_py(), _sets_in(t)
        members, out = np.flatnonzero(ids != hub), set()
        for h in np.flatnonzero(ids == hub):  # one, or each text of a repeated id
            both, sizes = _common(sets[h], [sets[i] for i in members]), np.array([len(sets[i]) for i in members], np.int64)
            out |= {int(ids[i]) for i in members[100 * both >= percent * (sizes + len(sets[h]) - both)]}
        return pa.table({"a": pa.array(sorted(out), pa.int64()), "b": pa.array([hub] * len(out), pa.int64())})

    return run


def _candidates(percent: int):
    """Members of a block pair that may link with a member of another component there, by their sketches."""

    def run(t: pa.Table) -> pa.Table:
        side, at, n = (t.column(c).to_numpy() for c in ("side", "at", "n"))
        band = t.column("key")[0].as_py() & (BANDS - 1)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(at), -1)
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(at), BANDS)
        right, hit = np.flatnonzero(side != 1), np.zeros(len(at), bool)
        for i in np.flatnonzero(side != 2):
            j = right[(right > i) if side[i] == 3 else slice(None)]
            j = j[(at[j] != at[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            j = j[(keys[j] == keys[i]).argmax(axis=1) == band]  # the pair's first band is the one to compare it
            if len(j):
                same, either = ((sig[j] == sig[i]) & (sig[i] > 0)).sum(axis=1), ((sig[j] > 0) | (sig[i] > 0)).sum(axis=1)
                j = j[may_reach(same, either, n[j], n[i], percent / 100)]
                hit[j] = True
                hit[i] |= len(j) > 0
        return t.select(["key", "x", "y", "side", "id", "at"]).filter(pa.array(hit))

    return run


def _linked(percent: int):
    """A forest of the links between members of different components of a block pair: fewer rows than members.

    Finer registers made from the sets at hand screen the pairs; what may link is decided on the full sets.
    """

    def run(t: pa.Table) -> pa.Table:
        side, ids, sets = t.column("side").to_numpy(), t.column("id").to_numpy(), _sets_in(t)
        at = np.unique(t.column("at").to_numpy(), return_inverse=True)[1]
        n = np.array([len(s) for s in sets], np.int64)
        fine = np.stack([narrowed(registers(s, FINE_BITS)) for s in sets])
        right, a, b = np.flatnonzero(side != 1), [], []
        for i in np.flatnonzero(side != 2):
            j = right[(right > i) if side[i] == 3 else slice(None)]
            j = j[(at[j] != at[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            same, either = ((fine[j] == fine[i]) & (fine[i] > 0)).sum(axis=1), ((fine[j] > 0) | (fine[i] > 0)).sum(axis=1)
            j = j[may_reach(same, either, n[j], n[i], percent / 100, 4)]
            both = _common(sets[i], [sets[k] for k in j])
            for k in j[100 * both >= percent * (n[j] + n[i] - both)]:
                if at[k] != at[i]:
                    a.append(ids[i])
                    b.append(ids[k])
                    at[at == at[k]] = at[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _parts(members: Column, shingles: Column) -> Column:
    """Blocks that a group with so many members and shingles is split into."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (columns doc_id long, text string; others ignored).

    Documents link when 100 * |A and B| >= percent * |A or B| on their whole shingle sets. Copies of one set meet by
    the set's 128-bit mark before banding, so a group of copies is one vertex however large. First every vertex is
    compared with one hub: of the best members of its buckets the one it shares most bands with. So near copies of one
    text meet their likely source, not each other. Buckets that then still hold several components compare all pairs of
    different ones, in blocks of bounded size within tasks: by their sketches, then, where a member may link, on full
    sets. A task gives out a forest, fewer rows than its members; no pair leaves it, and none that shares a bucket is lost.

    Null or blank text: n_shingles 0, linked with nothing. Null doc_id: linked with nothing, component_id null, kept
    true. Repeated rows count as copies and each gets a row; texts of one repeated id are one vertex. Ties need no rule:
    the smallest id stands for a component. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    base = staged(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, mark binary, sig binary, keys array<long>"), "near-base")
    known = base.where("doc_id is not null and n_shingles > 0")
    reps = staged(known.groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")), "near-reps")

    # buckets with several members; their keys by member, so that later joins need one row for each member
    bands = reps.select("mark", "id", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = bands.join(shared, "key").groupBy("mark", "id", "n").agg(F.collect_list("key").alias("open"), F.sum("members").alias("degree"))  # BANDS keys at most
    member = staged(member, "near-members")

    # the hub of a bucket is the member that shares the most bands with others: of a group of near copies, the least changed
    rows = member.select("id", "n", "degree", F.explode("open").alias("key"))
    hubs = rows.groupBy("key").agg(F.max(F.struct(F.col("degree"), (-F.col("id")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("hub"), F.col("best.degree").alias("d"))
    met = rows.join(hubs, "key").where("id != hub").groupBy("id").agg(F.collect_list(F.struct("hub", "d")).alias("met"))  # BANDS hubs at most
    votes = F.transform(F.array_distinct("met"), lambda h: F.struct(F.size(F.filter("met", lambda x: x == h)).alias("votes"), h["d"].alias("d"), (-h["hub"]).alias("minus")))
    pairs = met.select("id", (-F.array_max(votes)["minus"]).alias("hub"))
    known_of = lambda **names: reps.select(*[F.col(c).alias(a) for c, a in names.items()])
    pairs = pairs.join(known_of(id="id", sig="sig", n="n"), "id").join(known_of(id="hub", sig="hub_sig", n="hub_n"), "hub")
    pairs = pairs.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    hopeful = staged(pairs.mapInArrow(_hopeful(percent), "id long, hub long, n long").distinct(), "near-hopeful")

    def with_sets(of: DataFrame) -> DataFrame:
        """`of` with the shingles of its column `id`, every text of that id."""
        sets = semi_join(texts, of.select("id").distinct(), "id").mapInArrow(_sets, "id long, shingles binary")
        return of.join(sets, "id").where(F.length("shingles") > 0)

    stars = hopeful.groupBy("hub").agg(_parts(4 * F.count(F.lit(1)), F.sum("n")).alias("parts"))  # of 128 members
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    asked = hopeful.join(stars, "hub").select("id", "hub", part.alias("part"))
    asked = staged(asked.unionByName(stars.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))), "near-asked")
    links = staged(with_sets(asked).groupBy("hub", "part").applyInArrow(_star(percent), "a long, b long"), "near-links")
    found = connected_components(links)

    # the rest: buckets of several components
    placed = member.join(found, "id", "left").select("mark", "id", "n", "open", F.coalesce("component", "id").alias("at"))
    placed = staged(placed, "near-placed")
    wide = placed.select("id", "n", "at", F.explode("open").alias("key")).groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), _parts(F.count(F.lit(1)), F.sum("n")).alias("blocks")).where("lo != hi").select("key", "blocks")
    rest = placed.select("mark", "id", "at", F.explode("open").alias("key")).join(wide, "key").groupBy("mark", "id", "at").agg(F.collect_list(F.struct("key", "blocks")).alias("open"))
    rest = rest.join(reps.select("mark", "id", "n", "sig", "keys"), ["mark", "id"])
    # a member of block k stands on the left of block pairs (k, y > k), on the right of (x < k, k), on both sides of (k, k)
    own = F.pmod(F.xxhash64("id"), F.col("o.blocks"))
    block_pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o.blocks") - 1), lambda y: F.struct(F.least(own, y).alias("x"), F.greatest(own, y).alias("y"), F.when(y == own, 3).when(y > own, 1).otherwise(2).alias("side")))
    rest = rest.withColumn("o", F.explode("open")).withColumn("t", F.explode(block_pairs)).select(F.col("o.key").alias("key"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.side").alias("side"), "id", "at", "n", "sig", "keys")
    able = staged(rest.groupBy("key", "x", "y").applyInArrow(_candidates(percent), "key long, x long, y long, side int, id long, at long"), "near-able")
    more = staged(with_sets(able).groupBy("key", "x", "y").applyInArrow(_linked(percent), "a long, b long"), "near-more")
    if not more.isEmpty():
        found = connected_components(found.toDF("a", "b").unionByName(more))

    named = reps.select("mark", "id").join(found, "id", "left").select("mark", F.coalesce("component", "id").alias("at"))
    out = base.select("doc_id", "n_shingles", "mark").join(named, "mark", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("at", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
