"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import small_batches, staged

#: Labelled rows of each class that are examples (the first by hash, or about so many), votes, examples in a block.
EXAMPLES, VOTES, BLOCK = 1024, 15, 64
#: A term is a word, or the first bytes of a longer one.
STEM = 5
#: Weight of the share of toxic rows against one vote of cosine 1.
PRIOR_WEIGHT = 0.25

#: ASCII bytes that aren't letters or digits separate words here.
_SEPARATE = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def terms(text: str | None) -> dict[bytes, int]:
    """Terms of a whole text with their counts: lower-case words, and stems of longer words marked by a hyphen."""
    words = Counter((text or "").lower().encode("utf-8").translate(_SEPARATE).split())
    stems: dict[bytes, int] = {}
    for w, n in words.items():
        if len(w) > STEM:
            s = w[:STEM] + b"-"  # no word ends like that
            stems[s] = stems.get(s, 0) + n
    return words | stems


def label_weights(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How surely a term in `a` of n1 toxic and `b` of n0 other examples tells the labels apart.

    The square of its log odds ratio (half a row added) in standard errors; no term is left out. Without examples of
    both labels every term weighs 1.
    """
    if not n1 or not n0:
        return np.ones(len(a))
    return np.log((a + 0.5) * (n0 + 1) / ((b + 0.5) * (n1 + 1))) ** 2 / (1 / (a + 0.5) + 1 / (b + 0.5))


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class BlockMaxIndex:
    """Unit vectors of examples as postings by term and block of examples, with the largest weight of each such span.

    Terms that an eighth of the examples hold have their postings as a row over all examples: what these add to a cosine is
    one product, and known before the blocks are bounded.
    """

    def __init__(self, vocabulary: dict[bytes, int], weight: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, toxic: np.ndarray, ids: np.ndarray):
        """`row`, `term`, `tf`: one entry for each term of each example; `weight` of each term, by its number."""
        self.vocabulary, self.weight = vocabulary, weight
        w = (1 + np.log(tf)) * weight[term]
        norm = np.sqrt(np.bincount(row, w * w, len(ids)))
        # examples with the same heaviest term stand together, so that few blocks hold what matters to a text
        order = np.lexsort((w, row))
        last = np.flatnonzero(np.r_[row[order][1:] != row[order][:-1], True]) if len(row) else np.empty(0, np.int64)
        heaviest = np.full(len(ids), -1)
        heaviest[row[order][last]] = term[order][last]
        place = np.lexsort((ids, heaviest, toxic))
        self.toxic, self.ids, at = toxic[place], ids[place], np.argsort(place)
        doc, w = at[row], w / np.maximum(norm[row], 1e-300)
        full = np.bincount(term, minlength=len(weight)) * 8 >= max(len(ids), 1)
        self.place = np.where(full, np.cumsum(full) - 1, -1)
        self.rows = np.zeros((int(full.sum()), len(ids)))
        here = full[term]
        self.rows[self.place[term[here]], doc[here]] = w[here]
        doc, term, w = doc[~here], term[~here], w[~here]
        order = np.lexsort((doc, term))
        self.doc, self.w, term = doc[order].astype(np.int32), w[order], term[order]
        self.blocks = -(-len(ids) // BLOCK)
        span = term * max(self.blocks, 1) + self.doc // BLOCK
        self.first = np.flatnonzero(np.r_[True, span[1:] != span[:-1]]) if len(span) else np.empty(0, np.int64)
        self.top = np.maximum.reduceat(self.w, self.first) if len(span) else self.w
        self.block = (self.doc[self.first] // BLOCK).astype(np.int32)
        self.first = np.r_[self.first, len(span)]
        self.terms = np.searchsorted(term[self.first[:-1]] if len(span) else term, np.arange(len(weight) + 1))

    def nearest(self, text: str | None, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosines above 0, exactly, smaller positions first among equals; not the id `without`.

        A block's bound is the sum of its largest weights, and the common terms' share of a cosine is a lower bound of it.
        Blocks whose bound stays below the k-th of these can't hold a nearer example and are never scored.
        """
        return next(self.nearest_of([text], k, [without]))

    def nearest_of(self, texts: list[str | None], k: int, without: list[int | None] | None = None, together: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of each text; the rows of common terms are read once for `together` texts."""
        for lo in range(0, len(texts), together):
            queries, common = [], np.zeros((len(texts[lo : lo + together]), len(self.rows)))
            for i, text in enumerate(texts[lo : lo + together]):
                found = {self.vocabulary[t]: n for t, n in terms(text).items() if t in self.vocabulary}
                ts = np.fromiter(found, np.int64, len(found))
                q = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.weight[ts]
                norm = np.sqrt((q * q).sum())
                q = q / norm if norm else q
                place = self.place[ts]
                common[i, place[place >= 0]] = q[place >= 0]
                queries.append((ts, q) if norm and self.blocks else None)
            bases = common @ self.rows
            for i, query in enumerate(queries):
                yield self._nearest(*query, bases[i], k, without[lo + i] if without else None) if query else (np.empty(0, np.int64), np.empty(0))

    def _nearest(self, ts: np.ndarray, q: np.ndarray, base: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        spans = _spans(self.terms[ts], n := self.terms[ts + 1] - self.terms[ts])
        held, block = np.repeat(q, n), self.block[spans]
        bound = np.bincount(block, held * self.top[spans], self.blocks) + np.maximum.reduceat(base, np.arange(0, len(base), BLOCK))
        kth = np.partition(base, -k)[-k] if len(base) >= k and without is None else 0.0
        use = (bound >= kth - 1e-12) & (bound > 0)
        if use.all():
            at = _spans(self.first[self.terms[ts]], n := self.first[self.terms[ts + 1]] - self.first[self.terms[ts]])
            held = np.repeat(q, n)
        else:
            spans, held = spans[use[block]], held[use[block]]
            at = _spans(self.first[spans], n := self.first[spans + 1] - self.first[spans])
            held = np.repeat(held, n)
        score = np.where(np.repeat(use, BLOCK)[: len(base)], base + np.bincount(self.doc[at], held * self.w[at], len(base)), 0.0)
        if without is not None:
            score[self.ids == without] = 0
        score = np.round(score, 12)
        kth = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        best = np.flatnonzero((score >= kth) & (score > 0))
        best = best[np.argsort(-score[best], kind="stable")][:k]
        return best, score[best]

    def vote(self, best: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        """Share of toxic votes, weighted by cosine; the prior has a small weight of its own."""
        w = cosines * cosines
        return float(((w * self.toxic[best]).sum() + PRIOR_WEIGHT * prior) / (w.sum() + PRIOR_WEIGHT))


def calibration(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from votes to probabilities, by Newton steps with a little ridge."""
    x = np.c_[votes, np.ones_like(votes)]
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (toxic - p)) - 0.01 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 0.0), float(b[1])


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, term, tf = [], [], []
        for i, t in enumerate(b.column("text")):
            for w, n in terms(t.as_py()).items():
                at.append(i)
                term.append(w)
                tf.append(n)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(term, pa.binary()), pa.array(tf, pa.int64())], ["doc_id", "term", "tf"])


def _frequency(vocabulary: dict[bytes, int]):
    """Texts of a task that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for t in b.column(0):
                words = set((t.as_py() or "").lower().encode("utf-8").translate(_SEPARATE).split())
                words |= {w[:STEM] + b"-" for w in words if len(w) > STEM}
                hit = words & vocabulary.keys()
                if hit:
                    found[[vocabulary[w] for w in hit]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32)), pa.array(found[found > 0])], ["t", "df"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, training: Column) -> tuple[BlockMaxIndex | None, float, tuple[float, float]]:
    """The index, the share of toxic rows among all labelled training rows, and the calibration.

    Examples are EXAMPLES rows of each label at most (the first by hash of the id), the bounded sample this classifier
    is fitted on. All their terms are indexed. A term's weight is its idf, from its document frequency over all
    documents, times what the examples say of it (label_weights).
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(training & F.col("doc_id").isNotNull()).select("doc_id").join(marked, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("by"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    if not counts:
        return None, 0.0, (1.0, 0.0)
    rate = counts.get(1, 0) / sum(counts.values())
    # first a share by hash that holds EXAMPLES rows of each label all but surely, so that no task ranks a whole label
    bound = F.when(F.col("toxic") == 1, _share(counts.get(1, 0))).otherwise(_share(counts.get(0, 0)))
    ranked = rows.where(F.col("by") < bound).withColumn("at", F.row_number().over(Window.partitionBy("toxic").orderBy("by", "doc_id"))).where(F.col("at") <= EXAMPLES)
    chosen = staged(ranked.select("doc_id", "toxic").distinct(), "toxic-examples")
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxic-texts")  # EXAMPLES ids of each label
    label = {r["doc_id"]: r["toxic"] for r in chosen.collect()}
    found = sample.mapInArrow(_terms_of, "doc_id long, term binary, tf long").toArrow()  # the terms of EXAMPLES * 2 texts
    ids = np.array(sorted(label), np.int64)
    toxic = np.array([label[i] for i in ids], np.float64)
    row = np.searchsorted(ids, found.column("doc_id").to_numpy())
    coded = found.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    term, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    vocabulary = {t: i for i, t in enumerate(names)}
    tf = found.column("tf").to_numpy().astype(np.float64)
    del found, coded, names
    total, df = docs.count(), np.zeros(len(vocabulary))
    sums = docs.select("text").mapInArrow(_frequency(vocabulary), "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # a row for each term
    df[sums.column("t").to_numpy()] = sums.column("df").to_numpy()
    a, b = (np.bincount(term[toxic[row] == k], minlength=len(df)).astype(np.float64) for k in (1, 0))
    n1 = int(toxic.sum())
    index = BlockMaxIndex(vocabulary, (np.log((total + 1) / (df + 1)) + 1) * label_weights(a, b, n1, len(ids) - n1), row, term, tf, toxic, ids)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            votes = [index.vote(*index.nearest(t.as_py(), VOTES, i.as_py()), rate) for i, t in zip(*x.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(votes, pa.float64())], ["doc_id", "vote"])

    votes = sample.select("doc_id", "text").mapInArrow(others, "doc_id long, vote double").collect()  # each example by the others
    y, share = np.array([label[r["doc_id"]] for r in votes], np.float64), n1 / len(ids)
    # classes are weighted back to their shares among all labelled rows
    weight = np.where(y == 1, rate / max(share, 1e-9), (1 - rate) / max(1 - share, 1e-9))
    return index, rate, calibration(np.array([r["vote"] for r in votes]), y, weight)


def _share(rows: int) -> int:
    """Bound on a 30-bit hash that leaves EXAMPLES of `rows` rows and six standard errors more, or all."""
    return min(1 << 30, int((1 << 30) * (EXAMPLES + 6 * EXAMPLES**0.5) / max(rows, 1)))


def score(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """doc_id, score (0 to 1), evidence for every row of `docs` (doc_id, text; others ignored).

    `labels` (doc_id, toxic) is read for the rows of `docs` that meet the condition `training` and nothing else; a
    document labelled twice counts as toxic if one label says so. A text is compared with all examples of the index,
    exactly; the VOTES nearest vote with their squared cosines, and a logistic curve fitted to the examples' own
    leave-one-out votes makes a probability of it. `evidence` lists the voters: doc_id, toxic, cosine.

    Null and empty texts, and texts without a term of the index, have the score of the prior and no evidence. Without
    labelled training rows the score is 0. Repeated rows score alike; whole texts are read however long. An empty table
    gives an empty table.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, prior, (slope, shift) = fitted(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nothing = (np.empty(0, np.int64), np.empty(0))
            found = list(index.nearest_of(b.column(1).to_pylist(), VOTES) if index else itertools.repeat(nothing, b.num_rows))
            votes = np.array([index.vote(best, cos, prior) for best, cos in found] if index else [])
            scores = 1 / (1 + np.exp(-(slope * votes + shift))) if index else np.full(b.num_rows, prior)
            at, cos = (np.concatenate([*(f[i] for f in found), nothing[i]]) for i in (0, 1))
            voters = pa.StructArray.from_arrays([pa.array(index.ids[at]), pa.array(index.toxic[at].astype(np.int32)), pa.array(cos)] if index else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.float64())], ["doc_id", "toxic", "cosine"])
            why = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32()), voters)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), why], ["doc_id", "score", "evidence"])

    return docs.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")
