"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.llm.common import small_batches, staged
from dayline.llm.components import connected_components

#: Vectors a cell should hold, sample vectors a cell, rounds of k-means.
CELL, SAMPLE, ROUNDS = 2000, 32, 8
#: Bytes of all centres, which every task holds. Cells grow in number with the table up to this, and beyond it in size.
CENTRE_BYTES = 1 << 26
#: Added to the margin of cells for rounding.
SLACK = 1e-6
#: Rows on either side of a block.
BLOCK = 1024


def margin_of(least: float) -> float:
    """How near a cell boundary one of two unit vectors on its two sides lies at most, if their cosine is `least` or more.

    Their distances from the boundary add up to no more than their own distance, sqrt(2 - 2 * least).
    """
    return float(np.sqrt(max(0.0, 1 - least) / 2)) + SLACK


def _summed(centres: np.ndarray):
    """Sums of a task's vectors by their nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros_like(centres), np.zeros(len(centres), bool)
        for b in batches:
            raw = b.column(0).to_pylist()
            for lo in range(0, len(raw), 256):
                x = np.frombuffer(b"".join(raw[lo : lo + 256]), np.float64).reshape(-1, centres.shape[1])
                at = np.argmax(x @ centres.T, axis=1)
                np.add.at(sums, at, x)
                held[at] = True
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([sums[c].tobytes() for c in cells], pa.binary())], ["cell", "total"])

    return run


def _added(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float64) for x in group.column("total").to_pylist()], axis=0)
    return pa.table({"cell": group.column("cell")[:1], "total": pa.array([total.tobytes()], pa.binary())})


def spherical_kmeans(units: DataFrame, dim: int, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of a sample of the column `unit` (fewer where vectors are fewer); only centres reach the driver.

    The sample is about SAMPLE * k vectors by hash, the first centres about k of them. A round sums the sample's vectors by
    nearest centre in its tasks, one row for each centre and task, and the sums of a centre meet in one of them.
    """
    rows = units.where(F.length("unit") == 8 * dim).select("unit", F.pmod(F.xxhash64("unit"), F.lit(1 << 30)).alias("by"))
    n = rows.count()
    sample = staged(rows.where(F.col("by") < _share(SAMPLE * k, n)), "vector-sample")
    first = sample.where(F.col("by") < _share(k, n)).collect()  # about k vectors
    c = np.frombuffer(b"".join(r["unit"] for r in sorted(first, key=lambda r: (r["by"], r["unit"]))[:k]), np.float64).reshape(-1, dim).copy()
    for _ in range(rounds if len(c) > 1 else 0):
        found = sample.select("unit").mapInArrow(_summed(c), "cell long, total binary").groupBy("cell").applyInArrow(_added, "cell long, total binary").collect()  # a row for each centre
        for r in found:
            total = np.frombuffer(r["total"], np.float64)
            norm = np.linalg.norm(total)
            if norm > 1e-12:
                c[r["cell"]] = total / norm
    return c


def _share(wanted: int, rows: int) -> int:
    """Bound on a 30-bit hash below which `wanted` of `rows` rows and six standard errors more lie, or all."""
    return min(1 << 30, int((1 << 30) * (wanted + 6 * wanted**0.5) / max(rows, 1)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as doubles with a mark of their bytes; rows that can't link get none."""
    for b in batches:
        unit, mark = [], []
        for e, label in zip(b.column("embedding"), b.column("label"), strict=True):
            v = e.as_py()
            ok = v and label.is_valid and not any(x is None for x in v)
            u = np.asarray(v, np.float64) if ok else np.empty(0)
            top = np.abs(u).max() if len(u) else 0.0
            if len(u) and np.isfinite(u).all() and top > 0:
                u = u / top  # keeps squares of very small or large components in range
                raw = (u / np.sqrt((u * u).sum())).tobytes()
                unit.append(raw)
                mark.append(xxhash.xxh3_128_digest(raw))
            else:
                unit.append(None)
                mark.append(None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(unit, pa.binary()), pa.array(mark, pa.binary())], ["vec_id", "label", "unit", "mark"])


def _placed(centres: dict[int, np.ndarray], margin: float):
    """A row for each cell a vector lives in (first) or visits, with the list of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cells, lists = [], [], []
            for i, raw in enumerate(b.column("unit")):
                u = np.frombuffer(raw.as_py(), np.float64)
                c = centres.get(len(u))
                if c is None:
                    near = [0]
                else:
                    dots = c @ u
                    home = int(np.argmax(dots))
                    gap = (dots[home] - dots) / np.maximum(np.linalg.norm(c - c[home], axis=1), 1e-12)
                    near = [home, *(int(k) for k in np.flatnonzero(gap <= margin) if k != home)]
                at += [i] * len(near)
                cells += near
                lists += [near] * len(near)
            t = pa.Table.from_batches([b.select(["rep", "label", "copies", "unit"])]).take(pa.array(at, pa.int64())).combine_chunks()
            for x in t.append_column("cell", pa.array(cells, pa.int32())).append_column("near", pa.array(lists, pa.list_(pa.int32()))).to_batches():
                yield x

    return run


def _compared(least: float):
    def run(group: pa.Table) -> pa.Table:
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        cell, near = group.column("cell")[0].as_py(), group.column("near").to_pylist()
        left, right = group.column("side").to_numpy() != 2, group.column("side").to_numpy() != 1
        units = group.column("unit").to_pylist()
        links, edges = np.zeros(len(rep), np.int64), []
        for dim in {len(u) for u in units}:
            of = np.array([len(u) == dim for u in units])
            rows, cols = np.flatnonzero(of & left), np.flatnonzero(of & right)
            if not len(rows) or not len(cols):
                continue
            a = np.frombuffer(b"".join(units[i] for i in rows), np.float64).reshape(len(rows), -1)
            c = np.frombuffer(b"".join(units[i] for i in cols), np.float64).reshape(len(cols), -1)
            i, j = np.nonzero(a @ c.T >= least)
            i, j = rows[i], cols[j]
            # a block with itself holds each pair twice; a pair that meets in both its cells counts in the lower one
            keep = np.where(left[i] & right[i] & left[j] & right[j], i < j, True)
            i, j = i[keep], j[keep]
            if len(i):
                home_i, home_j = np.array([near[y][0] for y in i]), np.array([near[y][0] for y in j])
                # residents are on the left; a visitor's pair was counted in its own lower cell if the resident visits that
                twice = np.array([hj < hi and hj in near[x] for hi, hj, x in zip(home_i, home_j, i, strict=True)], bool) & (home_j != cell)
                i, j = i[~twice], j[~twice]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += _forest(i, j, len(rep))
        hit = np.flatnonzero(links)
        ids = [*rep[hit], *(rep[x] for x, _ in edges)]
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array([None] * len(hit) + [int(rep[y]) for _, y in edges], pa.int64()), "links": pa.array([*links[hit], *[0] * len(edges)], pa.int64())})

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(vertex, root) for every vertex of the links i-j: as few rows as vertices, however many links."""
    if not len(i):
        return []
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(v), int(label[v])) for v in np.unique(np.r_[i, j]) if label[v] != v]


def embedding_duplicates(vectors: DataFrame, least: float = 0.93, margin: float | None = None, cell_size: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding array of numbers, label; others ignored).

    Two vectors link when their labels are equal and not null, they have the same length, and the cosine of their
    doubles is at least `least`. Equal vectors of a label become one with a count. Centres come from k-means on a
    sample of SAMPLE vectors for each of them; every vector gets a home cell and visits those
    whose boundary is nearer than `margin`. The default, `margin_of(least)`, is wide enough that of any two vectors that
    link one visits the other's home, so no link is lost; a smaller one loses links. A cell's residents
    are split into blocks of `block` rows at most in the mean, and block pairs are compared as matrix products: a large
    cell is many tasks. A block sends on link counts and a spanning forest, not its pairs, so a group of near copies
    gives as many rows as it has members. The smallest vec_id of a component is kept.

    Null, empty, zero and non-finite vectors and null labels link with nothing (n_links 0, component_id their own id).
    A null vec_id links with nothing, component_id null, kept true. Rows that repeat a vector link with each other and
    count as other vectors. An empty table gives an empty table.
    """
    small_batches(vectors.sparkSession)
    base = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")).mapInArrow(_units, "vec_id long, label string, unit binary, mark binary"), "vectors")
    valid = base.where("vec_id is not null and mark is not null")
    reps = staged(valid.groupBy("label", "mark").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "vector-reps")
    dims = {r["bytes"] // 8: r["count"] for r in reps.groupBy(F.length("unit").alias("bytes")).count().collect()}  # one, unless lengths are mixed
    centres = {}
    for dim, n in dims.items():
        k = min(-(-n // cell_size), max(1, CENTRE_BYTES // len(dims) // (8 * dim)))
        if k > 1:
            centres[dim] = spherical_kmeans(reps, dim, k)

    placed = staged(reps.mapInArrow(_placed(centres, margin_of(least) if margin is None else margin), "rep long, label string, copies long, unit binary, cell int, near array<int>"), "vector-cells")
    home = F.col("near")[0] == F.col("cell")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if(home) / block).alias("blocks"), F.ceil(F.count_if(~home) / block).alias("guests"))
    p = placed.join(sizes.where("blocks > 0"), ["label", "cell"]).withColumn("own", F.when(home, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("guests"))))
    # residents of block x are the left side of (x, y >= x) and of (x, guests g), and the right side of (x' < x, x)
    every = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    pair = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    resident = F.concat(
        F.transform(every(F.col("own"), F.col("blocks") - one), lambda y: pair(F.col("own"), y, F.when(y == F.col("own"), 3).otherwise(1))),
        F.transform(every(zero, F.col("own") - one), lambda x: pair(x, F.col("own"), F.lit(2))),
        F.transform(every(zero, F.col("guests") - one), lambda g: pair(F.col("own"), -one - g, F.lit(1))),
    )
    guest = F.transform(every(zero, F.col("blocks") - one), lambda x: pair(x, -one - F.col("own"), F.lit(2)))
    tasks = p.withColumn("t", F.explode(F.when(home, resident).otherwise(guest))).select("label", "cell", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.side").alias("side"), "rep", "copies", "unit", "near")
    found = staged(tasks.groupBy("label", "cell", "x", "y").applyInArrow(_compared(least), "a long, b long, links long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("near_links"))
    comps = connected_components(found.where("b is not null").select("a", "b"), "vector-components").withColumnRenamed("id", "rep")
    named = reps.select("label", "mark", "rep", "copies").join(links, "rep", "left").join(comps, "rep", "left")
    named = named.select("label", "mark", (F.col("copies") - 1 + F.coalesce("near_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("at"))
    out = base.join(named, ["label", "mark"], "left")
    id_ = F.col("vec_id")
    known = id_.isNotNull()
    out = out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("at", id_)).alias("component_id"))
    return out.withColumn("kept", F.coalesce(id_ == F.col("component_id"), F.lit(True)))
