"""Hidden Markov language model: distributed Baum-Welch, exact likelihood by scaled forward recursion.

States emit word classes. The most frequent words are classes of their own and all others fall into classes by hash, so
the emission table stays small however many words a corpus has. Within a class a word has probability
(c + 1) / (n + v + 1) with its count c, the tokens n and the distinct words v of the class in the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.llm.common import WordHash, small_batches, staged, words

#: Words with a class of their own, classes for the rest, words whose counts every task holds, states.
OWN, HASHED, HEAD, STATES = 4096, 1024, 65_536, 8
#: Passes over all training texts, and the sample (runs, passes) from which the first parameters come.
ROUNDS, SAMPLE_RUNS, SAMPLE_ROUNDS = 4, 512, 12
#: Training counts a text in runs of RUN tokens side by side, each with AROUND tokens of the text before and after it, by
#: which the recursion has forgotten where it began. Scoring does not cut. Tokens that are counted at once.
RUN, AROUND, GROUP = 512, 24, 131_072
#: The end of a text; no word holds white space.
END = np.int64(np.uint64(xxhash.xxh3_64_intdigest(b"\n")).astype(np.int64))


def _hashes(text: str | None, memo: WordHash) -> np.ndarray:
    """Signed hashes of a text's tokens, the end last."""
    h = np.array([*map(memo.__getitem__, words(text)), 0], dtype=np.uint64).view(np.int64)
    h[-1] = END
    return h


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHash()
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            h, c = np.unique(np.concatenate([_hashes(t.as_py(), memo) for t in b.column(0).slice(lo, 2048)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])


@dataclass
class Vocabulary:
    """What every task holds: the head words by hash with rank and count, and the sizes of the hashed classes."""

    hashes: np.ndarray  # sorted
    rank: np.ndarray
    count: np.ndarray
    class_log: np.ndarray  # log10(n + v + 1) of the hashed classes


def _encoder(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        logs = np.log10(v.count + 1.0)
        for b in batches:
            cls, n, head_n, head_sum, own_sum, den, tails, tfs = [], [], [], [], [], [], [], []
            for t in b.column(3):
                h = _hashes(t.as_py(), memo)
                at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1) if len(v.hashes) else np.zeros(len(h), np.int64)
                head = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                rank = np.where(head, v.rank[at], HEAD) if len(v.hashes) else np.full(len(h), HEAD)
                own = rank < OWN
                hashed = (h.view(np.uint64) % np.uint64(HASHED)).astype(np.int64)
                cls.append(np.where(own, rank, OWN + hashed).astype(np.int16).tobytes())
                lg = logs[at[head]]
                n.append(len(h))
                head_n.append(int(head.sum()))
                head_sum.append(float(lg.sum()))
                own_sum.append(float(logs[at[own]].sum()) if own.any() else 0.0)
                den.append(float(v.class_log[hashed[~own]].sum()))
                w, tf = np.unique(h[~head], return_counts=True)
                tails.append(w)
                tfs.append(tf)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(head_n, pa.int64()), pa.array(head_sum, pa.float64()), pa.array(own_sum, pa.float64()), pa.array(den, pa.float64()), pa.array(cls, pa.binary()), pa.array(tails, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))],
                ["uid", "doc_id", "held_out", "n_tokens", "head_n", "head_sum", "own_sum", "den", "cls", "tail", "tf"],
            )

    return run


@dataclass
class Parameters:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def expected_counts(runs: list[tuple[np.ndarray, int, int]], p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of runs, all at once: row r of a step is the r-th longest run.

    A run is a class sequence and the part of it that counts: positions from `lo` to before `hi`. What stands around that
    part only tells the states at its edges. A move counts with the token it leads to, a start where a run counts from 0.
    """
    runs = sorted((r for r in runs if len(r[0])), key=lambda r: len(r[0]), reverse=True)
    k = len(p.start)
    lens, lo, hi = (np.array(x) for x in ([len(r[0]) for r in runs], [r[1] for r in runs], [r[2] for r in runs]))
    flat, first = np.concatenate([r[0] for r in runs]).astype(np.int64), np.r_[0, np.cumsum(lens)[:-1]]
    active = [int(np.searchsorted(-lens, -t, side="left")) for t in range(lens[0])]
    alphas, emits, scales = [], [], []
    a = np.broadcast_to(p.start, (len(runs), k))
    for t, n in enumerate(active):
        e = p.emit[flat[first[:n] + t]]
        a = (a[:n] @ p.move if t else a[:n]) * e
        c = a.sum(axis=1, keepdims=True)
        a = a / c
        alphas.append(a)
        emits.append(e)
        scales.append(c)
    move, emit, ids, gammas = np.zeros((k, k)), np.zeros(p.emit.shape), [], []
    beta = np.ones((active[-1], k))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        counts = ((lo[:n] <= t) & (t < hi[:n])).astype(np.float64)[:, None]
        gammas.append(alphas[t] * beta * counts)
        ids.append(flat[first[:n] + t])
        if t:
            right = emits[t] * beta / scales[t]
            move += alphas[t - 1][:n].T @ (right * counts)
            beta = np.ones((active[t - 1], k))
            beta[:n] = right @ p.move.T
    g, i = np.concatenate(gammas), np.concatenate(ids)
    for s in range(k):
        emit[:, s] = np.bincount(i, weights=g[:, s], minlength=len(emit))
    return gammas[-1].sum(axis=0), move * p.move, emit


def maximised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Parameters:
    """Parameters from counts; every state gets the weight of 20 tokens of the corpus's own classes, so nothing is impossible."""
    emit = emit + 20 * prior[:, None]
    move = move + 0.5 / len(start)
    start = start + 1.0 / len(start)
    return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _runs(raw: bytes) -> list[tuple[np.ndarray, int, int]]:
    """The runs of a whole text, which count each of its tokens once."""
    x = np.frombuffer(raw, np.int16)
    return [(x[max(0, i - AROUND) : i + RUN + AROUND], min(i, AROUND), min(i, AROUND) + min(RUN, len(x) - i)) for i in range(0, len(x), RUN)]


def _drawn(least: int):
    """Runs whose hash, salted by their place in the text, is below `least`, with that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw in b.column(0):
                for at, (x, lo, hi) in enumerate(_runs(raw.as_py())):
                    by = xxhash.xxh3_64_intdigest(x.tobytes(), seed=at) >> 1
                    if by < least:
                        found.append((by, x.tobytes(), lo, hi))
            by, x, lo, hi = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(by, pa.int64()), pa.array(x, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["by", "cls", "lo", "hi"])

    return run


def _gathered(p: Parameters):
    """Counts of a task as one row for each class; class -1 holds the starts, -2 - s the moves from state s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(p.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(p.emit.shape)
        group: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                for into, got in zip((start, move, emit), expected_counts(group, p), strict=True):
                    into += got
            group.clear()
            size = 0

        for b in batches:
            for raw in b.column(0):
                got = _runs(raw.as_py())
                for lo in range(0, len(got), GROUP // RUN):
                    group += got[lo : lo + GROUP // RUN]
                    size += sum(len(r[0]) for r in got[lo : lo + GROUP // RUN])
                    if size >= GROUP:
                        flush()
        flush()
        table = np.vstack([start, move, emit])
        ids = np.r_[[-1], -2 - np.arange(k), np.arange(len(emit))]
        keep = table.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep].astype(np.int32)), *[pa.array(table[keep, s]) for s in range(k)]], ["cls", *[f"s{s}" for s in range(k)]])

    return run


def log10_likelihood(texts: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Exact log10 probabilities of whole class sequences by the scaled forward recursion, all sequences side by side."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lens = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    if not len(lens) or not lens[0]:
        return out
    flat, first = np.concatenate([texts[i] for i in order]), np.r_[0, np.cumsum(lens)[:-1]]
    total = np.zeros(len(order))
    a = np.broadcast_to(p.start, (len(order), len(p.start)))
    n = len(order)
    for t in range(lens[0]):
        while lens[n - 1] <= t:
            n -= 1
        a = (a[:n] @ p.move if t else a[:n]) * p.emit[flat[first[:n] + t]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        total[:n] += np.log10(c)
    out[order] = total
    return out


def _scorer(p: Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = log10_likelihood([np.frombuffer(x, np.int16) for x in b.column(0).to_pylist()], p)
            yield pa.RecordBatch.from_arrays([pa.array(got), *b.columns[1:]], ["forward", *b.schema.names[1:]])

    return run


@dataclass
class Model:
    """What a fit leaves: coded texts, word counts, their sum and number, and the parameters after every round."""

    coded: DataFrame
    counts: DataFrame
    total: int
    distinct: int
    vocabulary: Vocabulary
    rounds: list[Parameters]


def fitted(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Word counts, classes and parameters of (doc_id, text, held_out): see hmm_scores."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    counts = staged(docs.where("not held_out").select("text").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "hmm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the head is what lies above a count that at most HEAD words reach, found from a histogram of counts in sixteenths of an octave
    grade = F.floor(F.log2("c") * 16)
    above, least = 0, 0
    for r in sorted(counts.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):  # 1,024 rows at most
        above += r["count"]
        if above > HEAD:
            least = r["grade"] + 1
            break
    head = sorted(counts.where(grade >= least).collect(), key=lambda r: (-r["c"], r["h"]))  # HEAD rows at most
    own = spark.createDataFrame([(r["h"],) for r in head[:OWN]], "h long")
    rest = counts.join(F.broadcast(own), "h", "left_anti")  # OWN rows at most
    # the class of a word is its unsigned hash modulo HASHED, a power of two
    sizes = {r["k"]: (r["n"], r["v"]) for r in rest.groupBy(F.col("h").bitwiseAND(F.lit(HASHED - 1)).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    by_hash = sorted(range(len(head)), key=lambda i: head[i]["h"])
    class_n = np.array([sizes.get(k, (0, 0)) for k in range(HASHED)], dtype=np.float64)
    vocabulary = Vocabulary(np.array([head[i]["h"] for i in by_hash], dtype=np.int64), np.array(by_hash, dtype=np.int64), np.array([head[i]["c"] for i in by_hash], dtype=np.float64), np.log10(class_n.sum(axis=1) + 1))
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, head_n long, head_sum double, own_sum double, den double, cls binary, tail array<long>, tf array<long>"
    coded = staged(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(_encoder(vocabulary), schema), "hmm-coded")

    prior = np.r_[[r["c"] for r in head[:OWN]], np.zeros(OWN - min(OWN, len(head))), class_n[:, 0]] + 1e-3
    prior /= prior.sum()
    rng = np.random.default_rng(seed)
    classes = OWN + HASHED
    emit = prior[:, None] * np.exp(rng.normal(0, 1, (classes, states)))
    p = Parameters(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))
    training = coded.where("not held_out").select("cls")
    runs = training.agg(F.coalesce(F.sum(F.ceil(F.octet_length("cls") / (2 * RUN))), F.lit(0))).first()[0]
    drawn = training.mapInArrow(_drawn(min((1 << 63) - 1, (SAMPLE_RUNS << 63) // max(runs, 1))), "by long, cls binary, lo int, hi int")
    sample = sorted((r["by"], bytes(r["cls"]), r["lo"], r["hi"]) for r in drawn.distinct().collect())  # about SAMPLE_RUNS runs at most, copies once
    sample = [(np.frombuffer(x, np.int16), lo, hi) for _, x, lo, hi in sample]
    for _ in range(SAMPLE_ROUNDS if sample else 0):
        p = maximised(*expected_counts(sample, p), prior)
    passed = [p]
    for _ in range(rounds if runs else 0):
        sums = training.mapInArrow(_gathered(p), "cls int, " + ", ".join(f"s{s} double" for s in range(states))).groupBy("cls").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).collect()
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for r in sums:
            row = np.array(r[1:])
            if r["cls"] >= 0:
                emit[r["cls"]] = row
            elif r["cls"] == -1:
                start = row
            else:
                move[-2 - r["cls"]] = row
        p = maximised(start, move, emit, prior)
        passed.append(p)
    return Model(coded, counts, total, distinct, vocabulary, passed)


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """Scores of every whole text of `docs` (doc_id, text, held_out boolean), learned from the rows that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (this model), in
    log10. Word counts are summed over partitions; tasks hold only the counts of the HEAD most frequent words, the rest
    meet theirs in a join. Parameters start from Baum-Welch on about SAMPLE_RUNS runs of all training texts, drawn by hash (only
    the start depends on them), then every round sums the expected counts of all training texts, whole: one row for each
    class and task, so a round sends states x classes numbers, whatever the corpus holds.

    Null text counts as empty: its only token is the end. Null held_out counts as false. Repeated rows count as often as
    they occur and each is scored. Without training rows every text has probability by uniform parameters. An empty
    table gives an empty table.
    """
    m = fitted(docs, states, rounds, seed)
    coded, counts, total, distinct, p = m.coded, m.counts, m.total, m.distinct, m.rounds[-1]
    pairs = coded.select("uid", F.explode(F.arrays_zip("tail", "tf")).alias("x")).select("uid", F.col("x.tail").alias("h"), F.col("x.tf").alias("tf"))
    tails = pairs.join(counts, "h").groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("tail_sum"), F.sum("tf").alias("tail_n"))
    scored = coded.select("cls", "uid", "doc_id", "held_out", "n_tokens", "head_n", "head_sum", "own_sum", "den").mapInArrow(_scorer(p), "forward double, uid long, doc_id long, held_out boolean, n_tokens long, head_n long, head_sum double, own_sum double, den double")
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    return scored.join(tails, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_n") + F.coalesce("tail_n", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("forward") + F.col("head_sum") - F.col("own_sum") + tail_sum - F.col("den")).alias("score"),
    )
