"""Alignment of two tokenizers' tokens by their byte ranges, and how often their tokens meet in a corpus."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import small_batches, staged

#: Tokens of encoded units that a task remembers before it starts anew; some 200 MB with their texts.
REMEMBERED = 4_000_000
#: Characters of the texts that are aligned at once.
SLICE_CHARS = 1_000_000
#: Bytes of text after which a batch of documents ends: a batch's token pairs meet the corpus's counts in one group.
BATCH_BYTES = 8_000_000

#: Before a single space or line feed between two characters that are no white space.
_UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A unit that is cut off again from its neighbours when units are put together.
_INNER = re.compile(r"[ \n]\S(?:.*\S)?\Z", re.S)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokenizer:
    """A byte-level BPE of the `tokenizers` library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        table = _byte_level()
        size = self.model.get_vocab_size()
        self.token = [bytes(table[c] for c in self.model.id_to_token(i)) if all(c in table for c in self.model.id_to_token(i)) else b"" for i in range(size)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """A BPE of the `sentencepiece` library, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

        if any(b"\n" in t for t in self.token if len(t) > 1) or any(b" " in t.lstrip(b" ") for t in self.token):
            raise ValueError("a piece goes over a line feed or the space before a word")

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which the library adds itself, or with a line feed, before which its space is taken away."""
        return self.model.encode(text, num_threads=1)[1:] if text[:1] == "\n" else self.model.encode(text[1:], num_threads=1)


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every span, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Encoder:
    """Ids of space + text by both tokenizers, for texts whose bytes both give back.

    A text is cut into units before a single space or line feed between other characters. Neither tokenizer has a token
    that goes over such a place, so the units' tokens side by side are the text's; units that come again are looked up.
    """

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.bytes = [np.array([len(t) for t in k.token], np.int64) for k in (a, b)]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.start, self.length = ([np.empty(0, np.int64), np.empty(0, np.int64)] for _ in range(2))
        self.same = np.empty(0, bool)

    def _learn(self, units: list[str]) -> None:
        """Encodes new units: those that stand in a text between others as one text, the rest one by one."""
        inner = [u for u in units if _INNER.match(u)]
        for lo in range(0, len(inner), 8192):
            some = inner[lo : lo + 8192]
            if not self._add(some):
                for u in some:
                    self._add([u])
        for u in units:
            if u not in self.index:
                self._add([u])

    def _add(self, units: list[str]) -> bool:
        """Remembers the units' ids, cut out of those of their concatenation; not if it isn't given back and is more than one unit."""
        text = "".join(units)
        found = [np.array(k.encode(text), np.int64) for k in (self.a, self.b)]
        same = all(b"".join([k.token[i] for i in ids.tolist()]) == text.encode() for k, ids in zip((self.a, self.b), found, strict=True))
        if not same and len(units) > 1:
            return False
        ends = np.cumsum([len(u.encode()) for u in units])
        for k, ids in enumerate(found):
            to = np.searchsorted(np.cumsum(self.bytes[k][ids]), ends) + 1 if same else np.array([len(ids)])
            self.start[k] = np.r_[self.start[k], len(self.flat[k]) + np.r_[0, to[:-1]]]
            self.length[k] = np.r_[self.length[k], np.diff(to, prepend=0)]
            self.flat[k] = np.r_[self.flat[k], ids]
        self.same = np.r_[self.same, np.full(len(units), same)]
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units)), strict=True))
        return True

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """All texts' ids by A and by B one after another, each with every text's number of them; none for a text that isn't given back."""
        if max(map(len, self.flat)) > REMEMBERED:
            self._forget()
        split = [_UNIT.split(" " + t) if t else [] for t in texts]
        units = list(chain.from_iterable(split))
        known = list(map(self.index.get, units))
        if None in known:
            self._learn(list(dict.fromkeys(u for u, k in zip(units, known, strict=True) if k is None)))
            known = list(map(self.index.__getitem__, units))
        at, n = np.array(known, np.int64), np.array([len(s) for s in split], np.int64)
        owner = np.repeat(np.arange(len(texts)), n)
        bad = np.zeros(len(texts), bool)
        bad[owner[~self.same[at]]] = True
        if bad.any():
            at, owner = at[~bad[owner]], owner[~bad[owner]]
        ids, counts = [], []
        for k in range(2):
            ids.append(self.flat[k][_spans(self.start[k][at], self.length[k][at])])
            counts.append(np.bincount(owner, self.length[k][at], len(texts)).astype(np.int64))
        return ids, counts


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of a Python worker, kept from task to task."""
    return Aligner(Encoder(ByteTokenizer(a_path), PieceTokenizer(b_path)))


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Stretches of the token ends `a` and `b`, which grow and share their last entry: the A and B indexes at which each ends, and 1 for one-to-one.

    From a common end the arrays are compared at the current shift, the difference of the indexes, in steps that double
    while all ends in a step agree, and are halved once they don't: such a stretch is one-to-one, each token a group with
    its partner. Where not even the next ends agree, the token behind moves on until both meet again: that is one
    group, and it changes the shift.
    """
    to_a, to_b, one = [], [], []
    i, n, shift = 0, len(a), 0
    while i < n:
        first = i
        if a[i] == b[i + shift]:
            i, step = i + 1, 1
            while i < n and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step += step
            if i >= n:
                i = n
            elif step > 1:
                step >>= 1
                while step > 1:  # not all of the last step agreed: of its halves as many as do
                    step >>= 1
                    if a[i : i + step] == b[i + shift : i + shift + step]:
                        i += step
            to_a.append(i)
            to_b.append(i + shift)
            one.append(1)
            if i == n:
                break
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        if i > first or j > first + shift:
            i += 1
            j += 1
            to_a.append(i)
            to_b.append(j)
            one.append(0)
            shift = j - i
    return to_a, to_b, one


def groups_of(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The A and B indexes at which each group ends."""
    to_a, to_b, one = (np.array(x, np.int64) for x in align(a, b))
    size = np.where(one == 1, np.diff(to_a, prepend=0), 1)
    back = np.repeat(np.cumsum(size), size) - np.arange(1, size.sum() + 1)  # how many groups of its stretch come after one
    return np.repeat(to_a, size) - back, np.repeat(to_b, size) - back


class Aligner:
    """Groups of texts' tokens, their decimals and links, for many texts at once: a text's end is an end of both."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.bytes = encoder.bytes
        self.width = len(encoder.b.token)
        #: Decimals of the ids with each mark that may follow them, padded with NUL.
        self.decimals = [{m: np.array([f"{i}{m}" for i in range(len(n))], "S") for m in (",", end)} for n, end in zip(self.bytes, "|;", strict=True)]

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, the groups as text, and a number a * width + b for each link, for every text."""
        ids, counts = self.encoder.encode(texts)
        ends = [np.cumsum(w[i]) for w, i in zip(self.bytes, ids, strict=True)]
        to_a, to_b = groups_of(ends[0].tolist(), ends[1].tolist())
        bounds = [np.r_[0, np.cumsum(n)] for n in counts]
        group = np.searchsorted(to_a, bounds[0], side="right")  # the groups before each text

        # A and B tokens of a group stand side by side, the last of each with its own mark
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        place = [np.arange(len(ids[0])) + np.repeat(to_b - size_b, size_a), np.arange(len(ids[1])) + np.repeat(to_a, size_b)]
        marked = np.empty(len(ids[0]) + len(ids[1]), f"S{max(t.itemsize for d in self.decimals for t in d.values())}")
        for k, to, end in ((0, to_a, "|"), (1, to_b, ";")):
            comma, last = self.decimals[k][","], self.decimals[k][end]
            text = comma[ids[k]].astype(marked.dtype)
            text[to - 1] = last[ids[k][to - 1]]
            marked[place[k]] = text

        # a group's links are the stretches between neighbouring ends within it: all of a group of one and one is one
        odd_a, odd_b = (np.repeat((size_a > 1) | (size_b > 1), n) for n in (size_a, size_b))
        inner = np.union1d(ends[0][odd_a], ends[1][odd_b])
        a, b = np.flatnonzero(~odd_a), np.flatnonzero(~odd_b)
        a, b = np.r_[a, np.searchsorted(ends[0], inner)], np.r_[b, np.searchsorted(ends[1], inner)]
        order = np.argsort(a, kind="stable")
        a = a[order]
        links = ids[0][a] * self.width + ids[1][b[order]]
        link = np.searchsorted(a, bounds[0])
        for t in range(len(texts)):
            lo, hi = bounds[0][t] + bounds[1][t], bounds[0][t + 1] + bounds[1][t + 1]
            text = marked[lo:hi].tobytes().translate(None, b"\0")[:-1].decode()
            yield int(counts[0][t]), int(counts[1][t]), int(group[t + 1] - group[t]), text, links[link[t] : link[t + 1]]


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers as planes of their bytes, lowest first, as many as the largest needs: high planes compress well."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _slices(batch: pa.RecordBatch, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows that hold about `most` characters together, or one longer text."""
    size = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy().cumsum()
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most)) + 1
        yield batch.slice(lo, hi - lo)
        lo = hi


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, batch long"


def align_tokens(docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times, batch for every row of docs (doc_id, text; others ignored).

    `groups` is the text `a1,a2|b1;a3|b2,b3` of decimal ids; `pairs` and `times` are the packed distinct pairs of linked
    ids and how often each is linked; `batch` numbers runs of documents of about `batch_bytes`, made while reading. Both
    files are such as every worker can read. Texts that are null, empty, or not given back by both tokenizers have no
    tokens. Texts are encoded and aligned whole, however long; repeated rows and null ids are rows like others.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        batch, read = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for part in _slices(whole):
                texts = part.column("text").to_pylist()
                rows = []
                for t, (n_a, n_b, n, groups, links) in zip(texts, aligner.aligned(texts), strict=True):
                    pairs, times = np.unique(links, return_counts=True)
                    rows.append((n_a, n_b, n, len(links), groups, _packed(np.diff(pairs, prepend=0)), _packed(times), batch))
                    read += len(t or "")
                    if read >= batch_bytes:
                        batch, read = batch + 1, 0
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "batch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ALIGNED)


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and their summed times."""
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(times), minlength=len(found)).astype(np.int64)


def _batch_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, pair, times) summed over neighbouring rows of one batch."""

    def out(key: int, pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        p, n = _summed(pairs, times)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), key)), pa.array(p), pa.array(n)], ["batch", "pair", "times"])

    key, pairs, times, held = None, [], [], 0
    for b in batches:
        for k, p, t in zip(b.column("batch").to_pylist(), b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
            if k != key or held > 4_000_000:
                if pairs:
                    yield out(key, pairs, times)
                key, pairs, times, held = k, [], [], 0
            pairs.append(np.cumsum(_unpacked(p)))
            times.append(_unpacked(t))
            held += len(pairs[-1])
    if pairs:
        yield out(key, pairs, times)


def _counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Each document's links by the corpus-wide counts of its pairs: how many are the best of their B id, and the counts' sum."""
    order = np.argsort(counts.column("pair").to_numpy())
    pair, count, best = (counts.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
    n_best, total = [], []
    for p, t in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, times = np.searchsorted(pair, np.cumsum(_unpacked(p))), _unpacked(t)
        n_best.append(int(times[best[at]].sum()))
        total.append(int((count[at] * times).sum()))
    keep = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return keep.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def pair_counts(batch_pairs: DataFrame, width: int) -> DataFrame:
    """pair, count, best: how many links hold a pair of ids, and whether no A id has more with the same B id.

    A pair has at most one row for each batch of documents before they are summed, and a B id one for each A id.
    """
    counts = batch_pairs.groupBy("pair").agg(F.sum("times").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair") % width)))


def alignment_statistics(aligned: DataFrame, width: int) -> DataFrame:
    """Per document n_best and count_sum beside its other columns (but pairs, times and batch), for a written result of align_tokens with groups_sha256.

    `width` is the B vocabulary's size. The documents of a batch meet the counts of the batch's pairs in one group: both
    are bounded by the batch's size, however common a pair is, and only a batch's distinct pairs take part in the
    corpus-wide sums.
    """
    pairs = staged(aligned.select("batch", "pairs", "times").mapInArrow(_batch_pairs, "batch long, pair long, times long"), "aligned-pairs")
    counts = staged(pair_counts(pairs, width), "pair-counts")
    mine = pairs.select("batch", "pair").distinct().join(counts, "pair")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return aligned.groupBy("batch").cogroup(mine.groupBy("batch")).applyInArrow(_counted, out)


def vocabulary_size(b_path: str) -> int:
    return len(PieceTokenizer(b_path).token)
