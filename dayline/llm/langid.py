"""Language of a text by compression: the language whose dictionary makes it smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.llm.common import small_batches, staged

#: Bytes of a language's dictionary, most rows it is taken from, and bytes of all dictionaries: the bound of the sample.
#: With more than DICTIONARIES / DICTIONARY languages each gets its share, so that none is left out.
DICTIONARY, ROWS, DICTIONARIES = 131_072, 160, 1 << 26
#: Rows up to so many characters come first in a sample.
SHORT = 8192
LEVEL = 5
#: A decision is narrow when the two smallest sizes differ by less than this share.
NARROW = 0.001

_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters become spaces.
_LETTERS_ONLY = bytes(i if i > 127 or re.match(r"[a-zA-Z]", chr(i)) else 32 for i in range(256))


def evidence(text: str) -> bytes:
    """The distinct lower-case words of a whole text in order of appearance, ASCII digits and marks removed.

    Repeats are left out because a compressor finds them in the text itself, whatever the dictionary.
    """
    return b" ".join(dict.fromkeys(text.lower().encode("utf-8").translate(_LETTERS_ONLY).split()))


class Languages:
    """Compressors with raw-content dictionaries, by language in code point order."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.compressors = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language (the first of equals), score, and margin: how much smaller it is than the next."""
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, 0.0
        raw = evidence(text)
        sizes = np.array([len(c.compress(raw)) for c in self.compressors], float)
        best = int(np.argmin(sizes))
        odds = np.exp((sizes[best] - sizes) / sizes[best] * 40)
        margin = 1.0 if len(sizes) < 2 else float((np.partition(sizes, 1)[1] - sizes[best]) / sizes[best])
        return self.names[best], float(1 / odds.sum()), margin


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([evidence(t) for t in b.column(2).to_pylist()], pa.binary())], ["lang", "at", "evidence"])


def learned_dictionaries(training: DataFrame) -> dict[str, bytes]:
    """Dictionaries from (text, lang): up to ROWS rows of each language, short texts first, then by hash of the text.

    This is the bounded sample the classifier is fitted on. A row's whole evidence goes in, or none of it where it
    doesn't fit any more; a language whose first text alone is larger than a dictionary gets that text.
    """
    rows = training.where("lang is not null and text is not null and length(trim(text)) > 0").select("lang", "text", (F.length("text") > SHORT).alias("long"), F.xxhash64("text").alias("by"))
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("long", "by"))).where(F.col("at") <= ROWS)
    found = staged(first.select("lang", "at", "text").mapInArrow(_evidence, "lang string, at int, evidence binary"), "language-sample")
    most = min(DICTIONARY, DICTIONARIES // max(found.select("lang").distinct().count(), 1))
    size = F.octet_length("evidence") + 1
    up_to = F.sum(size).over(Window.partitionBy("lang").orderBy("at"))
    texts: dict[str, list[bytes]] = {}
    for r in found.where(size > 1).withColumn("up_to", up_to).where((F.col("up_to") <= most) | (F.col("up_to") == size)).orderBy("lang", "at").toLocalIterator():
        texts.setdefault(r["lang"], []).append(bytes(r["evidence"]))
    return {k: b"\n".join(v) for k, v in texts.items()}


def identify(docs: DataFrame, training: Column, narrow: float = NARROW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row of `docs` (doc_id, text, lang), and its columns in `carry`.

    `training` is a condition on `docs`: only the text and lang of rows that meet it are learned from. A text's
    evidence is compressed with each language's dictionary and the smallest wins. `rejected` is true for `und` and for
    a margin below `narrow`: two languages explain such a text about equally well.

    Null text, text without a letter, and any text where nothing could be learned: `und`, score 0, rejected. Equal
    sizes: the first language by code point, rejected. Rows are independent: repeats, null ids and very long texts
    need no care. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    dictionaries = learned_dictionaries(docs.where(training).select("text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(dictionaries)
        for b in batches:
            got = [languages.decide(t.as_py()) for t in b.column(1)]
            found = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *found, *b.columns[2:]], ["doc_id", "lang_pred", "score", "margin", *carried])

    # carried columns have names of their own on the way, so they may be called like the results
    carried = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(x) for c, x in zip(carry, carried, strict=True)])
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double" + kinds)
    rejected = (F.col("lang_pred") == "und") | (F.col("margin") < narrow)
    return out.select("doc_id", "lang_pred", "score", "margin", rejected.alias("rejected"), *[F.col(x).alias(c) for c, x in zip(carry, carried, strict=True)])
