"""Byte-level BPE encoding and decoding by monoid tree reduction."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dayline.llm.common import small_batches

#: Entries of an encoder's two memos before each starts anew, and bytes of the longest piece remembered and of a leaf of the tree: some 100 MB at most.
PIECES, PAIRS, SHORT = 300_000, 150_000, 32


class TreeEncoder:
    """Encodes the matches of `pattern` by the merge ranks, each by a balanced tree over its bytes, whose leaves of up to SHORT bytes are merged plainly.

    The encodings of the two halves of a piece are joined at their boundary. A sequence of tokens is the encoding of
    its bytes exactly when every two neighbours are the encoding of theirs, so if the tokens at the boundary pass, the
    halves' encodings just follow each other. Else the bytes of a window of tokens round the boundary are encoded
    afresh, and the window doubles on the side where its edge token doesn't pass with the neighbour outside: once both
    edges pass, the tokens outside are final. Encoding a window takes time in proportion to its length, so a piece of n
    bytes takes n log n at most.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token = {v: k for k, v in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[:2], {1}).add(len(t))
        #: Lengths of the tokens that begin with two bytes, longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Encoding of some bytes by the merges themselves: lowest rank first, leftmost of equals."""
        get, none = self.ranks.get, 1 << 62
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple([self.ranks[p] for p in parts])

    def passes(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == (a, b)
        return got

    def window(self, raw: bytes) -> tuple[int, ...]:
        """Encoding of a window: from the left the longest token that passes with the one before it, else back a token.

        A place that led nowhere is never tried again, so each place is left at most once.
        """
        ranks, passes, end = self.ranks, self.passes, len(raw)
        dead = bytearray(end + 1)
        out: list[int] = []
        at, most = 0, end
        while at < end:
            for n in self.lengths.get(raw[at : at + 2], (1,)):
                if n <= most and not dead[at + n]:
                    t = ranks.get(raw[at : at + n])
                    if t is not None and (not out or passes(out[-1], t)):
                        out.append(t)
                        at += n
                        most = end - at
                        break
            else:
                dead[at] = 1
                most = len(self.token[out.pop()])
                at -= most
        return tuple(out)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        if self.passes(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of the window on either side
        while True:
            window = self.window(b"".join([self.token[t] for t in left[-i:] + right[:j]]))
            fits_left = i == len(left) or self.passes(left[-i - 1], window[0])
            fits_right = j == len(right) or self.passes(window[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + window + right[j:]
            i, j = (i if fits_left else min(2 * i, len(left))), (j if fits_right else min(2 * j, len(right)))

    def piece(self, raw: bytes) -> tuple[int, ...]:
        got = self.pieces.get(raw)
        if got is not None:
            return got
        rank = self.ranks.get(raw)
        if rank is not None:
            got = (rank,)
        elif len(raw) <= SHORT:
            got = self.merged(raw)
        else:
            half = len(raw) // 2
            got = self.join(self.piece(raw[:half]), self.piece(raw[half:]))
        if len(raw) <= SHORT:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[raw] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece = self.pieces.get, self.piece
        for m in self.split(text):
            raw = m.encode("utf-8")
            out += known(raw) or piece(raw)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, put together up a balanced tree."""
        if len(ids) > 4096:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join([self.token[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tokenizer file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little endian, as binary), decoded (binary) for every row (doc_id, text).

    `ranks_path` names a file that every worker has. Null and empty texts have no tokens; rows are independent, so
    repeated rows, null ids and extra columns need no care; texts are encoded whole however long. A text with a lone
    surrogate can't come from Spark. A long match that merges badly (a ruler of one character) takes n log n steps. An
    empty table gives an empty table.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(read_ranks(ranks_path), pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                ids = [encoder.encode(t.as_py() or "") for t in b.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


