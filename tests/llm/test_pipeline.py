"""The pipeline: its stages on null and repeated ids, and run() as a whole, against brute force."""

import random
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_operators import RANKS, WORDS, shingles

import corpus_pipeline as P
from dayline.llm import langid, mixing
from dayline.llm.common import held_out


def test_rows_with_null_and_repeated_ids(spark):
    text = [" ".join(WORDS[40 * k : 40 * k + 30]) for k in range(8)]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (2, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (4, text[3]), (5, text[4] + " tail"), (5, text[4]), (6, text[5]), (6, text[6])]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = P.exact_dedup_stage(spark, docs, "")
    want = [(1, text[0]), (1, text[1]), (None, text[2]), (4, text[3]), (5, text[4] + " tail"), (5, text[4]), (6, text[5]), (6, text[6])]
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter(want)
    near = P.near_dedup_stage(spark, exact, "").collect()
    left = Counter((r.doc_id, r.text) for r in near)
    assert sum(left.values()) == 7 and all(left[w] == 1 for w in want if w[0] != 5) and left[5, want[4][1]] + left[5, want[5][1]] == 1
    mixed = P.mixing_stage(spark, docs, "")
    took = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in took for _ in range(r.copies))
    coded = P.byte_bpe(spark, mixed, "").collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert Counter((r.doc_id, r.n_tokens) for r in coded) == Counter((r.doc_id, len(library.encode_ordinary(r.text))) for r in mixed.collect())


def test_columns_with_clashing_names_change_nothing(spark):
    """Every stage but the last, with extra columns named like what stages and operators make themselves."""
    base = [" ".join(WORDS[30 * k : 30 * k + 30]) for k in range(6)]
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t)) for i, t in enumerate([*base, base[0], base[1] + " ", base[2] + " tail"])]
    names = ["row", "id", "copies", "shard", "_0", "copy", "kept", "keep_id", "rejected", "component_id", "size", "_part"]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (P.exact_dedup_stage, P.near_dedup_stage, P.mixing_stage):
        want = Counter(r.doc_id for r in stage(spark, plain, "").collect())
        for value in (F.lit(0), F.lit("x")):
            got = stage(spark, plain.select("*", *[value.alias(n) for n in names]), "")
            assert Counter(r.doc_id for r in got.collect()) == want and set(got.columns) == {*P.COLUMNS, P.ROW}
    assert sum(Counter(r.doc_id for r in P.near_dedup_stage(spark, P.exact_dedup_stage(spark, plain.select("*", F.lit(0).alias("row")), ""), "").collect()).values()) == 6
    first = P.language_id(spark, plain.select("*", F.lit(0).alias("row"), F.lit("q").alias(P.ROW)), "").collect()
    assert len({r[P.ROW] for r in first}) == len(first) == P.language_id(spark, plain, "").count()


def test_the_whole_pipeline_against_brute_force(spark, tmp_path):
    """run() on a folder: rejected rows go, then copies, then near copies; what is left is mixed and encoded."""
    rng = random.Random(17)
    lexicon = {"aa": WORDS[:200], "bb": WORDS[200:]}
    rows = []
    for i in range(60):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join(rng.choice(lexicon[lang]) for _ in range(rng.randint(20, 60))), lang, "s" + str(i % 3)))
    rows += [(100, "12 34 !", "aa", "s0"), (101, None, "aa", "s0"), (102, " ", None, None)]
    rows += [(200 + i, rows[i][1].replace(" ", "  "), rows[i][2], "s1") for i in range(4)]
    rows += [(300 + i, rows[10 + i][1] + " tail", rows[10 + i][2], "s2") for i in range(4)] + [rows[0]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.text): r for r in langid.identify(docs, ~held_out(F.col("doc_id"), 4), carry=("text",)).collect()}
    left = [r for r in rows if not found[r[0], r[1]].rejected]
    assert len(left) == len(rows) - 3
    groups = {}
    for r in left:
        groups.setdefault("".join(r[1].split()), []).append(r)
    left = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    sets = {r[0]: shingles(r[1]) for r in left}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    left = [r for r in left if find(r[0]) == r[0]]
    assert len(left) == 60
    took = mixing.mix(spark.createDataFrame(left, "doc_id long, text string, lang string, source string")).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = {r[0]: r[1] for r in left}
    want = Counter((r.doc_id, len(library.encode_ordinary(texts[r.doc_id]))) for r in took for _ in range(r.copies))
    assert Counter((r.doc_id, r.n_tokens) for r in P.run(spark, str(tmp_path)).collect()) == want
