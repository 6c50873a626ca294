"""Corpus chunks, vector search, fuzzy titles and the measures of retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.functions.columns import clip, json_object
from dayline.functions.staging import staged


def chunk_pages(pages: DataFrame, n: int = 6, fallback: str = "untitled") -> DataFrame:
    """Chunks of up to `n` pages of (doc_id, page, text): trimmed texts that aren't empty, joined by a blank line.

    A chunk is labelled by its first page's first line, cut at 80 characters, or by `fallback` where that has no word.
    """
    p = pages.withColumn("chunk", F.floor(F.col("page") / n)).withColumn("text", F.trim("text")).where("text <> ''")
    c = p.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("t"))  # n pages at most
    c = c.withColumn("content", F.array_join("t.text", "\n\n"))
    return c.select("doc_id", "chunk", F.size("t").alias("pages"), F.concat_ws("-", "doc_id", "chunk").alias("chunk_id"), F.when(F.col("content").rlike(r"^[^\n]*\w"), F.substring(F.regexp_extract("content", r"^[^\n]*", 0), 1, 80)).otherwise(fallback).alias("label"), "content")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def fuzzy_match(files: DataFrame, titles: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Best title of each file: shared tokens over the file's tokens, first title on ties, at least `threshold`.

    Only tokens that some title holds matter: a file of n tokens needs ceil(threshold * n) such tokens, or it has no
    title. One with m of them shares that many with a title only if it shares one of its m - ceil(threshold * n) + 1
    that the fewest titles hold, so files (file_id, name) meet titles (title_id, title) on those. What meets is scored
    on the whole sets. Files with equal token sets are scored once.
    """
    f = files.select("file_id", F.array_sort(token_set(F.col("name"))).alias("toks")).where(F.size("toks") > 0)
    f = staged(f.withColumn("key", F.sha2(F.concat_ws(" ", "toks"), 256)), "file-tokens")
    t = titles.select("title_id", token_set(F.col("title")).alias("held"))
    tok = staged(t.select("title_id", F.explode("held").alias("tok")), "title-tokens")
    common = tok.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    need = F.ceil(F.lit(threshold) * F.col("n"))
    found = f.select("key", F.size("toks").alias("n"), F.explode("toks").alias("tok")).join(common, "tok").groupBy("key", "n").agg(F.sort_array(F.collect_set(F.struct("df", "tok"))).alias("m"))
    found = staged(found.where((F.size("m") >= need)).select("key", "n", F.col("m.tok").alias("m")), "matched-tokens")
    rare = found.select("key", F.explode(F.slice("m", F.lit(1), (F.size("m") - need + 1).cast("int"))).alias("tok"))
    pairs = rare.join(tok, "tok").select("key", "title_id").distinct()
    s = pairs.join(found, "key").join(t, "title_id").select("key", "title_id", (F.size(F.array_intersect("m", "held")) / F.col("n")).alias("score")).where(F.col("score") >= threshold)
    best = s.groupBy("key").agg(F.max(F.struct(F.col("score"), (-F.col("title_id")).alias("minus"))).alias("best"))
    return f.select("file_id", "key").join(best, "key").select("file_id", (-F.col("best.minus")).alias("title_id"), F.col("best.score").alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, then) -> Column:
    """`then(value)` with the value computed once, however often it occurs in nested lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return bound(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix, without a Python number for each component."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _units(rows: np.ndarray | list[list[float]]) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of each row of scores, smallest id among equals; -inf scores come last."""
    k = min(k, scores.shape[1])
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), np.int64)
    for i in range(len(scores)):
        at = np.flatnonzero(scores[i] >= kth[i])
        out[i] = at[np.lexsort((ids[at], -scores[i, at]))[:k]]
    return out


def _search(query_ids: np.ndarray, q: np.ndarray, category: np.ndarray | None, k: int, skip_self: bool, step: int = 1 << 21):
    """The k best of a task's rows (id, vector[, category]) for each query, kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, ids = np.full((len(q), 0), -np.inf), np.empty((len(q), 0), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, step // max(len(q), 1))):
                b = whole.slice(lo, max(1, step // max(len(q), 1)))
                own = b.column(0).to_numpy(zero_copy_only=False)
                score = np.round(q @ _units(_matrix(b.column(1))).T, 9)
                if category is not None:
                    score[category[:, None] != b.column(2).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                if skip_self:
                    score[query_ids[:, None] == own[None, :]] = -np.inf
                at = best_of(score, own, k)
                top, ids = np.hstack([top, np.take_along_axis(score, at, 1)]), np.hstack([ids, own[at]])
                if top.shape[1] > 4 * k:
                    top, ids = _kept(top, ids, k)
        top, ids = _kept(top, ids, k)
        hit = np.isfinite(top)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, hit.sum(axis=1))), pa.array(ids[hit]), pa.array(top[hit])], ["query_id", "id", "cosine"])

    return run


def _kept(top: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -top), axis=1)[:, :k]
    return np.take_along_axis(top, order, 1), np.take_along_axis(ids, order, 1)


def _search_cell(k: int, skip_self: bool):
    """The k best of the rows (id, vector, category) of a cogroup's right side for each query (id, vector, category) of its left side."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if not queries.num_rows or not rows.num_rows:
            return empty
        same = "category" in queries.column_names
        search = _search(queries.column("id").to_numpy(), _units(_matrix(queries.column("vector"))), queries.column("category").to_numpy() if same else None, k, skip_self)
        return pa.Table.from_batches(search(iter(rows.select(["id", "vector", *(["category"] if same else [])]).to_batches())))

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _vectors(df: DataFrame, key: str, same: str | None = None) -> DataFrame:
    """(id, vector[, category]) of usable vectors."""
    extra = [F.col(same).cast("long").alias("category")] if same else []
    return df.where(_usable(F.col("vector"))).select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *extra)


_FOUND = "query_id long, id long, cosine double"


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, same: str | None = None, skip_self: bool = False, block: int = 16_384) -> DataFrame:
    """(query_id, id, cosine, place): the k nearest rows of corpus (id, vector) for each of (query_id, vector).

    Exact: queries against all rows. Up to `block` counted queries travel to all tasks, so the rows stay where they are.
    More of them meet the rows in cells of a part of the queries and a part of the rows, each of about `block`: every
    query goes to all parts of the rows and every row to all parts of the queries, as one plan whatever their number.
    A cell sends on the k best of each of its queries. `same` names an integer column that must be equal in both;
    `skip_self` leaves out the row whose id is the query's. Cosines are rounded to 9 decimals, equal ones go by id.
    Vectors that are null, empty, zero or hold null or NaN find nothing and are never found.
    """
    q, c = _vectors(queries, "query_id", same), _vectors(corpus, "id", same)
    many = q.count()
    if many <= block:
        t = q.toArrow()  # `block` rows at most
        units = _units(_matrix(t.column("vector"))) if t.num_rows else np.empty((0, 0))
        search = _search(t.column("id").to_numpy(), units, t.column("category").to_numpy() if same else None, k, skip_self)
        found = c.mapInArrow(search, _FOUND) if t.num_rows else c.limit(0).select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("cosine"))
        return _top(found, k)
    parts = {"qs": -(-many // block), "rs": max(1, -(-c.count() // block))}
    spread = lambda df, own, other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts[own]))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[other] - 1).cast("long"))))
    cells = lambda df, own, other: spread(df, own, other).groupBy("qs", "rs")
    return _top(cells(q, "qs", "rs").cogroup(cells(c, "rs", "qs")).applyInArrow(_search_cell(k, skip_self), _FOUND), k)


def _nearest(b: pa.RecordBatch, centres: np.ndarray, probes: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch (id, vector) and the `probes` nearest cells of their vectors, nearest first.

    A slice has about `most` cosines, and a sixteenth of that in nearest cells, so that its size doesn't grow with the centres.
    """
    step = max(1, min(most // len(centres), most // 16 // probes))
    for lo in range(0, b.num_rows, step):
        part = b.slice(lo, step)
        yield part, np.argsort(-(_units(_matrix(part.column(1))) @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)


def _cells_of(centres: np.ndarray, probes: int, vectors: bool = True):
    """A row (id, vector, cell), or without `vectors` (id, cell), for each of the `probes` nearest cells of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, near in _nearest(b, centres, probes):
                take = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                kept = part.select(["id", "vector"] if vectors else ["id"]).take(take)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.ravel())], [*kept.schema.names, "cell"])

    return run


def _orders(centres: np.ndarray):
    """A row (id, order) for each vector: all cells, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, near in _nearest(b, centres, len(centres)):
                ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], ["id", "order"])

    return run


@dataclass
class CellIndex:
    """Vectors filed by the nearest of k-means centres, for an approximate search that looks into a query's nearest cells.

    `rows` (id, vector, cell) is every row of the corpus, written; `sizes` (cell, n) counts them.
    """

    centres: np.ndarray
    rows: DataFrame
    sizes: DataFrame

    @classmethod
    def fit(cls, corpus: DataFrame, cell: int = 1000, seed: int = 3, sample: int = 64) -> CellIndex:
        """Centres, one for `cell` rows, 2 to 4,096 of them, fitted on `sample` rows for each, drawn by hash; then all rows are filed."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = _vectors(corpus, "id")
        n = rows.count()
        cells = max(2, min(4096, n // cell))
        drawn = _drawn(rows, sample * cells, n, seed).select(array_to_vector("vector").alias("features"))
        fit = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(drawn)
        centres = _units([list(c) for c in fit.clusterCenters()])
        filed = staged(rows.mapInArrow(_cells_of(centres, 1), "id long, vector array<double>, cell int"), "cell-index")
        return cls(centres, filed, staged(filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes"))

    def probing(self, queries: DataFrame, probes: int) -> DataFrame:
        """(id, vector, cell): each query (query_id, vector) with its `probes` nearest cells."""
        return _vectors(queries, "query_id").mapInArrow(_cells_of(self.centres, probes), "id long, vector array<double>, cell int")

    def probes_for(self, queries: DataFrame, k: int, recall: float, skip_self: bool = False, trials: int = 256, seed: int = 3) -> int:
        """How many nearest cells hold the share `recall` of true neighbours, measured: `trials` queries drawn by hash are answered exactly."""
        asked = _vectors(queries, "query_id")
        trial = _drawn(asked, trials, asked.count(), seed).limit(2 * trials)
        trial = staged(trial if not trial.isEmpty() else asked.limit(trials), "trial-queries").withColumnRenamed("id", "query_id")
        true = vector_topk(trial, self.rows, k, skip_self=skip_self).select("query_id", "id")
        order = _vectors(trial, "query_id").mapInArrow(_orders(self.centres), "id long, order array<int>")  # 2 * trials at most
        ranks = true.join(self.rows.select("id", "cell"), "id").join(F.broadcast(order.withColumnRenamed("id", "query_id")), "query_id").select(F.array_position("order", F.col("cell")).alias("rank"))
        return int(np.ceil(ranks.agg(F.coalesce(F.percentile("rank", F.lit(recall)), F.lit(1.0))).first()[0]))

    def search(self, queries: DataFrame, k: int, probes: int, skip_self: bool = False, part: int = 4096) -> DataFrame:
        """(query_id, id, cosine, place) among the rows of each query's cells.

        Queries and rows meet by cell, in parts of about `part` of either, so that a hot cell is many tasks.
        """
        probing = self.probing(queries, probes)
        asked = probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part).alias("qs"))
        sizes = F.broadcast(asked.join(self.sizes.select("cell", F.ceil(F.col("n") / part).alias("rs")), "cell"))  # a row for each cell
        spread = lambda df, own, other: df.join(sizes, "cell").select("id", "vector", "cell", F.pmod(F.xxhash64("id"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))
        keys = ["cell", "qs", "rs"]
        return _top(spread(probing, "qs", "rs").groupBy(*keys).cogroup(spread(self.rows, "rs", "qs").groupBy(*keys)).applyInArrow(_search_cell(k, skip_self), _FOUND), k)

    def work(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, compared): how many rows each query is compared with."""
        cells = _vectors(queries, "query_id").mapInArrow(_cells_of(self.centres, probes, vectors=False), "id long, cell int")
        return cells.join(F.broadcast(self.sizes), "cell").groupBy(F.col("id").alias("query_id")).agg(F.sum("n").alias("compared"))


def _drawn(rows: DataFrame, wanted: int, of: int, seed: int) -> DataFrame:
    """About `wanted` of the `of` rows, by hash of their ids."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, wanted / max(of, 1)))))


def vector_topk_lsh(queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.95, skip_self: bool = False, cell: int = 1000, part: int = 4096, seed: int = 3) -> DataFrame:
    """(query_id, id, cosine, place) of an approximate search through a CellIndex that holds every row of corpus.

    How many cells a query looks into is measured for the wanted `recall`. Queries without a usable vector find nothing.
    """
    if _vectors(queries, "query_id").isEmpty() or _vectors(corpus, "id").isEmpty():
        return vector_topk(queries, corpus, k, skip_self=skip_self)
    index = CellIndex.fit(corpus, cell, seed)
    return index.search(queries, k, index.probes_for(queries, k, recall, skip_self, seed=seed), skip_self, part)


def nearest_category(rows: DataFrame, centres: DataFrame, most: int = 4096) -> DataFrame:
    """(id, category): the category of centres (category, vector) with the largest cosine, the smallest on ties.

    Up to `most` counted categories travel as one array, and no row is multiplied; more are searched as vectors.
    """
    if centres.count() > most:
        top = vector_topk(rows.select(F.col("id").alias("query_id"), "vector"), centres.select(F.col("category").alias("id"), "vector"), 1)
        return top.select(F.col("query_id").alias("id"), F.col("id").alias("category"))
    all_ = centres.agg(F.collect_list(F.struct("category", unit(F.col("vector")).alias("v"))).alias("cs"))
    score = lambda u: F.array_max(F.transform("cs", lambda c: F.struct(F.round(dot(u, c["v"]), 9).alias("cosine"), (-c["category"]).alias("minus"))))
    best = bound(unit(F.col("vector")), score)
    return rows.join(F.broadcast(all_)).withColumn("best", best).where("best.cosine is not null").select("id", (-F.col("best.minus")).alias("category"))


def with_fallback(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """The filtered hits, and the unfiltered ones of queries that have none."""
    return filtered.unionByName(unfiltered.join(filtered.select("query_id").distinct(), "query_id", "left_anti"))


def hit_measures(hits: DataFrame, k: int) -> DataFrame:
    """Of (query_id, place, hit boolean): precision over k and over the returned, and the reciprocal rank."""
    first = F.min(F.when(F.col("hit"), F.col("place")))
    return hits.groupBy("query_id").agg((F.count_if("hit") / k).alias("precision_k"), (F.count_if("hit") / F.count(F.lit(1))).alias("precision_returned"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"))


def retrieval_shape(hits: DataFrame) -> DataFrame:
    """Average and top similarity, distinct sources and the share of the commonest one, for each query."""
    per = hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("c"), F.sum("cosine").alias("s"), F.max("cosine").alias("m"))
    return per.groupBy("query_id").agg((F.sum("s") / F.sum("c")).alias("avg_similarity"), F.max("m").alias("top_similarity"), F.count(F.lit(1)).alias("unique_sources"), (F.max("c") / F.sum("c")).alias("concentration"))


def judge_score(response: Column) -> Column:
    """The `score` of a JSON answer, else its first number from 0 to 1; kept within [0, 1], null without one."""
    given = F.get_json_object(json_object(response), "$.score").try_cast("double")
    found = F.regexp_extract(response, r"(?<![\d.])(0(?:\.\d+)?|1(?:\.0+)?)(?![\d.])", 1)
    return clip(F.coalesce(given, found.try_cast("double")), 0.0, 1.0)


def pack_context(entries: DataFrame, budget: int = 6000) -> DataFrame:
    """Entries (pid, place, text) of each pid in order until one would exceed the budget of characters."""
    w = Window.partitionBy("pid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    kept = entries.withColumn("used", F.sum(F.length("text")).over(w)).where(F.col("used") <= budget)
    return kept.groupBy("pid").agg(F.count(F.lit(1)).alias("entries"), F.max("used").alias("chars"), F.array_join(F.sort_array(F.collect_list(F.struct("place", "text")))["text"], "\n").alias("context"))
