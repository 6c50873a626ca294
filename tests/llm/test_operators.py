"""Each operator against a brute-force version, and on nulls, empty and repeated rows, ties and clashing columns."""

import base64
import hashlib
import itertools
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayline.llm import bpe, embed_dedup, exact_dedup, hmm, html_extract, langid, mixing, near_dedup, sharding, toxicity
from dayline.llm.components import connected_components

#: Extra columns whose names clash with those of results.
SCHEMA = "doc_id long, text string, lang string, source string, size int, component_id string, kept string, score string, n string, h int"


def docs_of(spark, rows):
    """rows of (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 7, "x", "y", "z", "q", 3) for r in rows], SCHEMA)


RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def text_of(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE\ttwo"), (5, "é É"), (None, "null id text here for all"), (6, "same " * 2000)]
    base = [text_of(rng.randint(30, 120), rng) for _ in range(12)]
    i = 10
    for b in base:
        for edits in (0, 1, 2, 4, 8):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((i, " ".join(w)))
            i += 1
    rows += [rows[20], rows[20], (500, rows[21][1].upper())]
    return rows


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(known, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert all(sizes[i] == len(s) for i, s in known)


def test_near_duplicates_of_one_large_group(spark):
    """Many edits of one text: pairs near the threshold, several components in every bucket."""
    rng = random.Random(9)
    base = text_of(100, rng).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_registers_keep_zeros_and_mantissa():
    s = np.array([(5 << 57) | (1 << 56) | (1 << 55), (5 << 57) | (1 << 30)], dtype=np.uint64)
    s.sort()
    r = near_dedup.registers(s)
    assert np.count_nonzero(r) == 1 and r[5] >> near_dedup.MANTISSA == 27 and r[5] & 1023 == 0


def test_components_are_smallest_reachable(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 8: 8, 9: 8, **{100 + i: 100 for i in range(41)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hmm_likelihood_is_exact_and_counts_are_right(spark):
    rng = np.random.default_rng(1)
    p = hmm.Parameters(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    seqs = [np.array([1, 4, 0, 2]), np.array([5]), np.array([3, 3, 1])]
    for s, got in zip(seqs, hmm.log10_likelihood(seqs, p), strict=True):
        total = sum(p.start[q[0]] * p.emit[s[0], q[0]] * np.prod([p.move[q[i - 1], q[i]] * p.emit[s[i], q[i]] for i in range(1, len(s))]) for q in itertools.product(range(3), repeat=len(s)))
        assert abs(got - np.log10(total)) < 1e-9
    start, move, emit = hmm.expected_counts([(s, 0, len(s)) for s in seqs], p)
    want_start, want_move, want_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in seqs:
        paths = list(itertools.product(range(3), repeat=len(s)))
        each = [p.start[q[0]] * p.emit[s[0], q[0]] * np.prod([p.move[q[i - 1], q[i]] * p.emit[s[i], q[i]] for i in range(1, len(s))]) for q in paths]
        for q, share in zip(paths, np.array(each) / sum(each), strict=True):
            want_start[q[0]] += share
            for i, c in enumerate(s):
                want_emit[c, q[i]] += share
                if i:
                    want_move[q[i - 1], q[i]] += share
    assert np.allclose(start, want_start) and np.allclose(move, want_move) and np.allclose(emit, want_emit)


def test_hmm_runs_count_what_the_whole_text_counts(monkeypatch):
    rng = np.random.default_rng(3)
    p = hmm.Parameters(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4) * 2, 4), rng.dirichlet(np.ones(9), 4).T)
    texts = [rng.integers(0, 9, n).astype(np.int16) for n in (1, 39, 40, 41, 500, 1203)]
    whole = hmm.expected_counts([(t, 0, len(t)) for t in texts], p)
    monkeypatch.setattr(hmm, "RUN", 40)
    runs = [r for t in texts for r in hmm._runs(t.tobytes())]
    assert sum(hi - lo for _, lo, hi in runs) == sum(map(len, texts))
    for got, want in zip(hmm.expected_counts(runs, p), whole, strict=True):
        assert np.allclose(got, want, rtol=1e-5, atol=1e-6)


def test_hmm_rounds_over_partitions(spark):
    """A round's sums over partitions are those of one machine, the likelihood rises, and scores are those of the last parameters."""
    rng = random.Random(9)
    a, b = WORDS[:150], WORDS[150:300]
    rows = [(i, " ".join(rng.choice(a if (i + k // 30) % 2 else b) for k in range(rng.randint(1, 90)))) for i in range(150)]
    d = docs_of(spark, rows).withColumn("held_out", F.col("doc_id") % 7 == 2)
    m = hmm.fitted(d.repartition(5), rounds=3)
    coded = {r.doc_id: np.frombuffer(r.cls, np.int16) for r in m.coded.collect()}
    train = [coded[i] for i in coded if i % 7 != 2]
    like = [hmm.log10_likelihood(train, p).sum() for p in m.rounds]
    assert all(y > x for x, y in zip(like, like[1:], strict=False))
    classes = np.bincount(np.concatenate(train), minlength=hmm.OWN + hmm.HASHED) + 1e-3
    one = hmm.maximised(*hmm.expected_counts([(t, 0, len(t)) for t in train], m.rounds[0]), classes / classes.sum())
    assert np.allclose(one.move, m.rounds[1].move) and np.allclose(one.emit, m.rounds[1].emit) and np.allclose(one.start, m.rounds[1].start)
    counts = {r.h: r.c for r in m.counts.collect()}
    memo = hmm.WordHash()
    texts, got = dict(rows), {r.doc_id: r.score for r in hmm.hmm_scores(d, rounds=3).collect()}
    for i in coded:
        want = float(hmm.log10_likelihood([coded[i]], m.rounds[-1])[0])
        for h, c in zip(hmm._hashes(texts[i], memo).tolist(), coded[i].tolist(), strict=True):
            if c >= hmm.OWN:  # a word's share of its class
                want += np.log10(counts.get(h, 0) + 1) - m.vocabulary.class_log[c - hmm.OWN]
        assert abs(got[i] - want) < 1e-6


def test_hmm_scores(spark):
    rng = random.Random(2)
    a, b = WORDS[:150], WORDS[150:300]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(60))) for i in range(120)] + [(200, None), (201, ""), (202, "never seen words"), (0, "X y")]
    d = docs_of(spark, rows).withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = hmm.hmm_scores(d, rounds=2).collect()
    train = [t for i, t in rows if i % 7 != 2]
    counts = {}
    for t in train:
        for w in [*(t or "").lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        options = [t for i, t in rows if i == r.doc_id]
        want = [(len(w), sum(x in counts for x in w), sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) for w in ([*(t or "").lower().split(), None] for t in options)]
        assert any(r.n_tokens == a and r.n_known == k and abs(r.base_score - s) < 1e-6 for a, k, s in want) and r.train_tokens == n and np.isfinite(r.score)
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.hmm_scores(d.limit(0)).count() == 0
    assert hmm.hmm_scores(d.withColumn("held_out", F.lit(True)).limit(3)).count() == 3


RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abehlnrtz ", max_size=200), st.text(" \n\té漢😀", max_size=80), st.text("a", max_size=300)))
def test_bpe_equals_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["=" * 100_000, "\n" * 100_000, "a" * 100_000, "aB" * 50_000, "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(100_000)), "漢字" * 15_000])
def test_bpe_of_one_very_long_match(text):
    fresh = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN)
    began = time.process_time()
    ids = fresh.encode(text)
    assert time.process_time() - began < 5 and ids == LIBRARY.encode_ordinary(text)
    assert len(fresh.pieces) <= bpe.PIECES and max(map(len, fresh.pieces)) <= bpe.SHORT


def test_bpe_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "antidisestablishmentarianism" * 400), (3, "x"), (3, "x")]
    got = bpe.encode_and_decode(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert bpe.encode_and_decode(docs_of(spark, rows).limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert sorted((r.n_tokens, bytes(r.ids).hex(), bytes(r.decoded)) for r in got) == sorted((len(x := LIBRARY.encode_ordinary(t or "")), np.array(x, "<u4").tobytes().hex(), (t or "").encode()) for _, t in rows)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16))
    rows = [(i, [float(x) for x in v[i]], int(i % 3)) for i in range(300)]
    for i in range(300, 420):
        j = int(rng.integers(0, 40))
        rows.append((i, [float(x) for x in v[j] + rng.normal(size=16) * 0.15], int(j % 3)))
    rows += [(420, None, 1), (421, [0.0] * 16, 1), (422, [float("nan")] * 16, 1), (423, [None] * 16, 1), (424, rows[0][1], None), (425, [1.0] * 8, 0), (426, [2.0] * 8, 0), (None, rows[0][1], 0), (427, [], 0)]
    rows += [rows[5], (428, rows[5][1], rows[5][2])]
    valid = [(i, np.array(e), lab) for i, e, lab in rows if i is not None and lab is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links, parent = {}, {}
    for k, (i, *_r) in enumerate(valid):
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (ka, a), (kb, b) in itertools.combinations(enumerate(valid), 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
            links[ka] = links.get(ka, 0) + 1
            links[kb] = links.get(kb, 0) + 1
            x, y = sorted((find(a[0]), find(b[0])))
            parent[y] = x
    want = sorted((a[0], links.get(k, 0), find(a[0])) for k, a in enumerate(valid))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cell, block in ((2000, 1024), (60, 32)):
        got = embed_dedup.embedding_duplicates(df.withColumn("near", F.lit("x")).withColumn("copies", F.lit(2)), cell_size=cell, block=block, margin=2.0).collect()
        assert len(got) == len(rows)
        ids = {a[0] for a in valid}
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in ids) == want
        assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in ids)
    assert embed_dedup.embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.93, 0.8])
def test_embeddings_of_a_hot_group_lose_no_link_over_many_cells(spark, least):
    """A third of the vectors lies in two directions around one centre, so that many cells cut through it."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(1200, 24))
    v[:500] = 0.0
    v[:500, 0] = 1.0
    v[:500, 1:3] = rng.normal(size=(500, 2)) * 0.5
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(x) for x in e], 1) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.embedding_duplicates(df, least=least, cell_size=20, block=64).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(axis=1).tolist()))


def test_language_identification(spark):
    rng = random.Random(8)
    lexicon = {"aa": WORDS[:130], "bb": WORDS[130:260], "cc": WORDS[260:]}
    rows = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, text_of(30000, rng), None), (None, rows[0][1], None)]
    d = docs_of(spark, rows)
    got = langid.identify(d, F.col("doc_id") % 4 != 2, carry=("lang", "score", "text")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    odd = {r.doc_id: r for r in got if r.doc_id in (900, 901, 902)}
    assert all(r.lang_pred == "und" and r.rejected and r[2] == 0 for r in odd.values())
    assert all(0 <= r[2] <= 1 for r in got)
    assert langid.identify(d.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(d.limit(4), F.lit(False)).collect()} == {"und"}


def test_mixing_targets_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng.randint(0, 80), rng), None, rng.choice(["a"] * 6 + ["b", "c", "d"])) for i in range(900)]
    rows += [(2000, None, None, "a"), (2001, "x y", None, None), (None, "z", None, "b"), (2002, "big " * 5000, None, "a"), (2003, "", None, "empty")]
    d = docs_of(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    for rs in by.values():
        s = sum(r.size for r in rs)
        assert rs[0].source_size == s and rs[0].target <= 3 * s + 1e-9
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 3 * max(r.size for r in rs) + 1
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rs)
    again = mixing.mix(d.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(d.limit(0)).count() == 0


def test_sharding_is_a_permutation_with_exact_sizes(spark):
    d = spark.createDataFrame([(i if i % 9 else None, i % 5, 7) for i in range(1003)], "doc_id long, size long, text_crc32 long")
    got = sharding.shuffle_into_shards(d, ["doc_id", "size", "text_crc32"], 24, rows_per_partition=100).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert len(shards) == 24 and {len(v) for v in shards.values()} <= {41, 42}
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    again = sharding.shuffle_into_shards(d.repartition(5), ["doc_id", "size", "text_crc32"], 24, rows_per_partition=100).collect()
    key = lambda r: (str(r.doc_id), r.size, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shuffle_into_shards(d.limit(0), ["doc_id"], 24).count() == 0
    m = sharding.communication_matrix([10, 0, 300], 7, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 300] and set(m.sum(axis=0)) <= {44, 45}


def test_sharding_passes_columns_of_any_name(spark):
    names = ["row", "k0", "from", "at", "upto", "mark", "part", "start", "n", "within", "_from", "_mark", "a.b", "id"]
    plain = spark.range(300).select(F.col("id").alias("doc_id"))
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(plain, ["doc_id"], 7, rows_per_partition=20).collect()}
    more = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names], F.lit("x").alias("shard"), F.lit("y").alias("slot"))
    got = sharding.shuffle_into_shards(more, ["doc_id"], 7, rows_per_partition=20)
    assert got.columns == ["doc_id", *names, "shard", "slot"]
    assert all(want[r.doc_id] == (r.shard, r.slot) and all(r[c] == f"{c}{r.doc_id}" for c in names) for r in got.collect())


def test_matrix_rows_are_drawn_apart_and_have_the_law_of_one_draw():
    counts, shards = [40, 0, 25, 35], 3
    drawn = np.array([sharding.communication_matrix(counts, shards, s) for s in range(3000)])
    assert (drawn.sum(axis=2) == counts).all() and (drawn.sum(axis=1) == [34, 33, 33]).all() and (drawn >= 0).all()
    mean = np.outer(counts, [34, 33, 33]) / 100
    var = mean * (1 - np.array([34, 33, 33]) / 100) * ((100 - np.array(counts)[:, None]) / 99)
    assert np.abs(drawn.mean(axis=0) - mean).max() < 0.3 and np.abs(drawn.var(axis=0) - var).max() < 0.08 * var.max()
    # a partition's row takes some ten halvings of the draws, however many partitions there are
    assert sharding.matrix_row(np.arange(1025) * 100, 700, 24, 1).sum() == 100


def test_large_hypergeometric_draws_have_the_right_mean():
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 2_000_000_000, 6_000_000_000, 400) for _ in range(300)]
    assert abs(np.mean(draws) - 100) < 2 and 6 < np.std(draws) < 11


@pytest.mark.parametrize("hot_share", [1 / 128, 1.0])
def test_exact_duplicates_equal_brute_force(spark, hot_share):
    rng = random.Random(6)
    rows = corpus() + [(1000 + i, "Hot  text" + " " * rng.randint(0, 3)) for i in range(80)] + [(3000, "hot text")]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i))
    got = exact_dedup.exact_duplicates(docs_of(spark, rows), hot_share=hot_share, parts=4).collect()
    want = sorted((str(m[2]), str(min(g)[2]), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for m in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_block_max_search_is_exact():
    """Against dense cosines, over an index of many blocks."""
    rng = np.random.default_rng(3)
    rows = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, int(rng.integers(1, 9)), replace=False)} for _ in range(400)]
    weight, names = rng.uniform(0, 4, 40) ** 3, [b"t%d" % t for t in range(40)]
    row, term, tf = (np.array(x) for x in zip(*[(d, t, n) for d, r in enumerate(rows) for t, n in r.items()], strict=True))
    ids = np.arange(400) + 1000
    index = toxicity.BlockMaxIndex({n: t for t, n in enumerate(names)}, weight, row, term, tf.astype(float), rng.integers(0, 2, 400).astype(float), ids)
    assert index.blocks > 4
    dense = np.zeros((400, 40))
    dense[row, term] = (1 + np.log(tf)) * weight[term]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    for d, r in enumerate(rows[:60]):
        best, cos = index.nearest(" ".join(names[t].decode() + " " for t, n in r.items() for _ in range(n)), 15, 1000 + d)
        want = dense @ dense[d]
        want[d] = 0
        assert np.allclose(cos, np.sort(want)[::-1][: len(cos)]) and (len(cos) == 15 or (want > 1e-12).sum() == len(cos))
        assert np.allclose(cos, want[index.ids[best] - 1000])


def test_toxicity_equals_dense_cosines(spark):
    """The whole score but for the logistic curve: terms, frequencies over all documents, weights, cosines and votes."""
    rng = random.Random(14)
    rows = [(i, text_of(rng.randint(3, 40), rng) + (" vileterm" if i % 5 == 0 else "")) for i in range(160)]
    lab = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs_of(spark, rows), lab, F.col("doc_id") % 4 != 2).collect()
    tc = {i: toxicity.terms(t) for i, t in rows}
    train = [i for i, _ in rows if i % 4 != 2]
    names = sorted({t for i in train for t in tc[i]})
    at = {t: k for k, t in enumerate(names)}
    df = np.array([sum(t in c for c in tc.values()) for t in names])
    a, b = (np.array([sum(t in tc[i] for i in train if (i % 5 == 0) == k) for t in names], float) for k in (True, False))
    n1 = sum(i % 5 == 0 for i in train)
    w = (np.log(161 / (df + 1)) + 1) * np.log((a + 0.5) * (len(train) - n1 + 1) / ((b + 0.5) * (n1 + 1))) ** 2 / (1 / (a + 0.5) + 1 / (b + 0.5))

    def unit(c):
        v = np.zeros(len(names))
        for t, n in c.items():
            if t in at:
                v[at[t]] = (1 + np.log(n)) * w[at[t]]
        return v / max(np.linalg.norm(v), 1e-300)

    dense = np.array([unit(tc[i]) for i in train])
    for r in got:
        cos = np.sort(dense @ unit(tc[r.doc_id]))[::-1][: toxicity.VOTES]
        assert np.allclose([e.cosine for e in r.evidence], cos[: len(r.evidence)]) and (cos[len(r.evidence) :] < 1e-9).all()


def test_toxicity_scores(spark):
    rng = random.Random(4)
    bad = ["nastyword", "vileterm"]
    rows, labels = [], []
    for i in range(240):
        w = text_of(rng.randint(10, 60), rng).split()
        if i % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(900, None), (901, ""), (902, "Nastyword! " * 9000), (None, "vileterm"), (0, rows[0][1])]
    labels += [(0, 1, 1), (None, 1, 1), (777, 0, None)]
    d, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, lab, F.col("doc_id") % 4 != 2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    s = {r.doc_id: r.score for r in got}
    assert all((s[i] >= 0.3) == (i % 6 == 0) for i in range(240))
    assert s[900] < 0.3 and s[901] < 0.3 and s[902] >= 0.3 and s[None] >= 0.3
    assert all(e.toxic in (0, 1) and 0 < e.cosine <= 1 + 1e-9 for r in got for e in r.evidence)
    assert {r.score for r in toxicity.score(d, lab.limit(0), F.lit(True)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), lab, F.lit(True)).count() == 0


def test_toxicity_knows_rare_words_of_many_examples_and_of_few(spark):
    """A word in 10 of all toxic examples and in no clean one is evidence; so is one of fewer than 30 labelled rows."""
    rng = random.Random(12)
    neutral = lambda: text_of(6, rng)
    rows = [(i, neutral() + (" rareslur" if i % 2 and i < 20 else " nastyword" if i % 2 else "")) for i in range(2 * toxicity.EXAMPLES)]
    labels = [(i, 1, i % 2) for i in range(2 * toxicity.EXAMPLES)]
    rows += [(9000, neutral() + " rareslur"), (9001, neutral())]
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") < 9000).where("doc_id >= 9000").collect()}
    slurs = {i for i in range(1, 20, 2)}
    assert slurs <= {e.doc_id for e in got[9000].evidence} and got[9000].score >= 0.5 > got[9001].score
    few = spark.createDataFrame([(i, 1, int(i in slurs)) for i in range(1, 26)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows[:26] + rows[-2:]), few, F.col("doc_id") < 9000).where("doc_id >= 9000").collect()}
    assert slurs <= {e.doc_id for e in got[9000].evidence} and got[9000].score > got[9001].score


def page(main, host="h.example", nav="Home About"):
    return f"<!DOCTYPE html><html><head><title>T</title><script>if (a<b) {{x='</p>'}}</script></head><body class='has-sidebar'><nav><ul><li>{nav}</ul></nav><div class=\"ad\">Buy</div>{main}<footer>&copy; us</footer></body></html>"


def test_html_blocks():
    b = html_extract.blocks_of(page("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>four <b>x</b>y</article>"))
    assert [t for r, t in b if r == html_extract.ARTICLE] == ["A & B", "one two three", "four xy"]
    b = html_extract.blocks_of("<article><p>kept</p><section class='comments'><p>bad</p></section><form>f</form><aside>s</aside><p>end &lt;p&gt; &am")
    assert [t for r, t in b if r == html_extract.ARTICLE] == ["kept", "end <p> &am"]
    assert html_extract.blocks_of(None) == [] and html_extract.blocks_of("") == []


def test_repeated_runs_equal_brute_force():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 50, 9)
    streams = [np.r_[rng.integers(0, 50, rng.integers(0, 20)), common[: rng.integers(5, 10)], rng.integers(0, 50, 3)] for _ in range(12)] + [np.array([], np.int64)]
    got = html_extract.repeated(streams, 5, 3)
    grams = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - 4):
            grams.setdefault(tuple(s[i : i + 5]), set()).add(p)
    for p, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 4):
            if len(grams[tuple(s[i : i + 5])]) >= 3:
                want[i : i + 5] = True
        assert (got[p] == want).all()


def test_html_extraction(spark):
    same = "<div>All our pages carry this very same long notice text</div>"
    rows = [(i, f"http://H.example/{i}", page(same + f"<div>Unique body number {i} with words {WORDS[i]}</div>").replace("<footer", "<footer")) for i in range(6)]
    rows += [(10, "http://a.example/1", page("<article><p>Whole article shared by many pages of this host</p></article>"))] * 4
    rows += [(20, None, None), (21, "", ""), (22, "not a url", "<p>plain"), (None, "http://x/", "<p>t")]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, text string")
    for chunk in (4_000_000, 300):
        got = html_extract.extract(df, chunk).collect()
        assert len(got) == len(rows)
        t = {r.page_id: r.text for r in got}
        assert t[10] == "Whole article shared by many pages of this host" and t[20] == "" and t[21] == "" and t[22] == "plain"
    t = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert all(t[i] == f"Unique body number {i} with words {WORDS[i]}" for i in range(6))
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_repeats_are_those_of_the_whole_host(spark):
    """A large host gives the same texts as one in a single array; copies of a page and repeated rows count once."""
    notice, twice, copied = ("<div>All our pages carry this very same long notice text</div>", "<div>Only two of our pages ever held this line of text</div>", "<div>One page was stored under three addresses with this line of text</div>")
    rows = [(i, f"http://big.example/{i}", page((notice if i % 3 == 0 else "") + (twice if i in (1, 2) else "") + f"<div>Unique body number {i} with words {WORDS[i]}</div>")) for i in range(12)]
    rows += [(100 + i, f"http://big.example/copy{i}", page(copied)) for i in range(3)] + [(200, "http://big.example/again", page("<div>This row was read three times by the crawler</div>"))] * 3
    want = {i: "\n\n".join(([] if i not in (1, 2) else ["Only two of our pages ever held this line of text"]) + [f"Unique body number {i} with words {WORDS[i]}"]) for i in range(12)}
    want |= {100 + i: "One page was stored under three addresses with this line of text" for i in range(3)} | {200: "This row was read three times by the crawler"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (4_000_000, 300):
        got = html_extract.extract(df, chunk).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_html_keeps_what_markup_cut_short(spark):
    """Unclosed elements that aren't raw text, text of a main element beside articles, and names that would drop most of a page."""
    texts = lambda h: [t for r, t in html_extract.blocks_of(h) if r == html_extract.ARTICLE]
    for name in ("select", "object", "noscript", "iframe", "svg", "math", "canvas"):
        assert texts(f"<article><p>before<{name}><p>after</article>") == ["before", "after"]
        assert texts(f"<article><p>before<{name}>inside</{name}><p>after</article>") == ["before", "after"]
    assert texts("<article><p>before<script>var a = '<p>x</p>'") == ["before"]
    rows = [
        (1, "http://a.example/", "<main><p>Our index of many things</p><article>first teaser</article><article>second teaser</article></main><footer>us</footer>"),
        (2, "http://b.example/", "<nav>Home</nav><div class='page with-sidebar'><p>All the words of this page stand here</p></div><p>short</p>"),
        (3, "http://b.example/x", "<div><p>All the words of this page stand here too</p></div><div class='sidebar'>short</div>"),
    ]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Our index of many things\n\nfirst teaser\n\nsecond teaser", 2: "All the words of this page stand here\n\nshort", 3: "All the words of this page stand here too"}


def test_html_extraction_equals_brute_force(spark):
    """The final texts of pages without articles: blocks that runs of three distinct pages of the host cover by half are dropped."""
    rng = random.Random(21)
    notices = [text_of(9, rng) for _ in range(6)]
    rows = []
    for i in range(60):
        blocks = [text_of(rng.randint(3, 14), rng) for _ in range(4)] + [n for n in notices if rng.random() < 0.2] + [notices[0][: len(notices[0]) // 2] + " " + text_of(8, rng)]
        rng.shuffle(blocks)
        rows.append((i, f"http://h{i % 4}.example/{i}", "".join(f"<div>{b}</div>" for b in blocks), blocks))
    run, grams = html_extract.RUN, {}
    streams = {i: [w for b in blocks for w in b.split()] for i, _, _, blocks in rows}
    for i, s in streams.items():
        for k in range(len(s) - run + 1):
            grams.setdefault((i % 4, *s[k : k + run]), set()).add(i)
    want = {}
    for i, _, _, blocks in rows:
        s, at, kept = streams[i], 0, []
        hit = [False] * len(s)
        for k in range(len(s) - run + 1):
            if len(grams[(i % 4, *s[k : k + run])]) >= html_extract.PAGES:
                hit[k : k + run] = [True] * run
        for b in blocks:
            n = len(b.split())
            if sum(hit[at : at + n]) / n < html_extract.COVERED:
                kept.append(b)
            at += n
        want[i] = "\n\n".join(kept)
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for chunk in (4_000_000, 1500):
        assert {r.page_id: r.text for r in html_extract.extract(df, chunk).collect()} == want


def test_language_is_the_smallest_compression(spark):
    """The decision by each dictionary on its own, ties by code point; a language whose texts are all long or few is learned whole."""
    rng = random.Random(31)
    lexicon = {"aa": WORDS[:130], "bb": WORDS[130:260], "cc": WORDS[260:]}
    rows = [(i, " ".join(rng.choice(lexicon[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(500, " ".join(rng.choice(lexicon["aa"]) for _ in range(9000)), "zz"), (501, "qqqq zzzz", None), (502, "a", None)]
    d = docs_of(spark, rows)
    dictionaries = langid.learned_dictionaries(d.select("text", "lang"))
    assert sorted(dictionaries) == ["aa", "bb", "cc", "zz"] and set(dictionaries["zz"].split()) == set(rows[90][1].encode().split())
    for k in lexicon:
        assert set(dictionaries[k].split()) == {w for r in rows if r[2] == k for w in r[1].encode().split()}
    got = {r.doc_id: r for r in langid.identify(d, F.lit(True)).collect()}
    for i, t, _ in rows:
        sizes = {}
        for k, raw in dictionaries.items():
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = len(c.compress(langid.evidence(t)))
        best = min(sizes, key=lambda k: (sizes[k], k))
        assert got[i].lang_pred == best and got[i].rejected == (sorted(sizes.values())[1] == sizes[best] or got[i].margin < langid.NARROW)


def test_sharding_deals_by_the_matrix_and_shuffles_uniformly(spark):
    """Counts from each logical partition are those of the matrix; over many seeds each row meets each shard and slot alike."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"))
    n, shards = 600, 5
    where = np.zeros((n, shards))
    first = []
    for seed in range(12):
        got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(rows, ["doc_id"], shards, seed, rows_per_partition=100).collect()}
        assert sorted(got.values()) == [(s, k) for s in range(shards) for k in range(n // shards)]
        part = {r.doc_id: r.p for r in rows.select("doc_id", F.pmod(F.xxhash64(F.lit(seed), F.lit("partition"), "doc_id"), F.lit(6)).alias("p")).collect()}
        counts = [sum(p == k for p in part.values()) for k in range(6)]
        matrix = sharding.communication_matrix(counts, shards, seed)
        assert all(sum(part[i] == p and got[i][0] == s for i in got) == matrix[p, s] for p in range(6) for s in range(shards))
        for i, (s, _) in got.items():
            where[i, s] += 1
        first.append([i for i, x in sorted(got.items(), key=lambda kv: kv[1])])
    expected = 12 / shards
    chi2 = ((where - expected) ** 2 / expected).sum()
    assert abs(chi2 - n * (shards - 1)) < 6 * (2 * n * (shards - 1)) ** 0.5
    corr = np.corrcoef(np.array(first))
    assert np.abs(corr[np.triu_indices(12, 1)]).max() < 0.25
    assert abs(np.corrcoef(first[0], np.arange(n))[0, 1]) < 0.2


@pytest.mark.parametrize("run", [
    lambda d: near_dedup.near_duplicates(d), lambda d: hmm.hmm_scores(d.withColumn("held_out", F.lit(False))), lambda d: mixing.mix(d), lambda d: langid.identify(d, F.lit(True)),
    lambda d: exact_dedup.exact_duplicates(d), lambda d: sharding.shuffle_into_shards(d.select("doc_id", "text"), ["doc_id", "text"]),
])
def test_empty_tables(spark, run):
    assert run(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
