"""Token alignment, conversation tries and URL templates against brute force."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayline.llm import prefix_trie, queries, token_alignment, url_templates
from dayline.llm.common import staged

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "  ", "\n", "\t x", "word", " word", "  two  gaps ", "line\nnext line\n\nlast\n", "\nfirst", "end \n", "a\n b", "it's John's, isn't it?!", "<|endoftext|> and </s> <s> <unk> <0x41>",
    "▁ looks like a space", "a\x00b \x7f\x1c c\x85d\u00a0e\u2003f", "日本語 のテキスト。\n新しい行", "émigré naïve Übergröße ñandú", "👩‍👩‍👧‍👦 family 🇩🇪", "=" * 5000, "ab" * 3000, "\n" * 300 + "x", "x" + " " * 300, "e\u0301 combining", "1234567890 3.14159e-10 0x7fff",
    "one two three one two three", "one two three one two three",
]


def _alignment_by_sets(rows):
    """Whole texts encoded at once, groups by common ends, links by all ends, counts by a dictionary."""
    a, b = token_alignment.ByteTokenizer(A), token_alignment.PieceTokenizer(B)
    docs, count = [], collections.Counter()
    for doc, text in rows:
        ia = a.model.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(a.token[i] for i in ia) != raw or b"".join(b.token[i] for i in ib) != raw:
            ia, ib = [], []
        ends = [list(itertools.accumulate(len(t.token[i]) for i in ids)) for t, ids in ((a, ia), (b, ib))]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            x, y = bisect.bisect_right(ends[0], c), bisect.bisect_right(ends[1], c)
            groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            i, j = x, y
        links = [(ia[bisect.bisect_left(ends[0], e)], ib[bisect.bisect_left(ends[1], e)]) for e in sorted(set(ends[0]) | set(ends[1]))]
        count.update(links)
        docs.append((doc, len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((d, na, nb, g, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), h) for d, na, nb, g, ls, h in docs), key=str)


def _aligned(df, batch_bytes=token_alignment.BATCH_BYTES):
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = staged(token_alignment.align_tokens(df, A, B, batch_bytes).withColumn("groups_sha256", sha).drop("groups"), "aligned")
    out = token_alignment.alignment_statistics(aligned, token_alignment.vocabulary_size(B))
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()), key=str)


@pytest.mark.parametrize("batch_bytes", [1, 10**7])
def test_alignment_equals_brute_force(spark, batch_bytes):
    rows = [*enumerate(TEXTS), (None, "null id"), (None, "null id")]
    df = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, batch int, pairs string, groups int")
    assert _aligned(df.repartition(3), batch_bytes) == _alignment_by_sets(rows)


def test_alignment_of_random_strings_and_of_no_rows(spark):
    rng = random.Random(3)
    pool = [" ", " ", "\n", "a", "bc", "the", "ß", "é", "▁", "\t", ".", "''", "12", "日", "\x85", "\u3000", "🙂", "'s", "\r\n"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    assert _aligned(spark.createDataFrame(rows, "doc_id long, text string"), 300) == _alignment_by_sets(rows)
    assert _aligned(spark.createDataFrame([], "doc_id long, text string")) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(0, 2**32))
def test_align_finds_the_common_ends(n, seed):
    rng = random.Random(seed)
    share = rng.choice([0.1, 0.5, 0.9, 0.99])
    a = sorted({i for i in range(1, n) if rng.random() < share} | ({n} if n else set()))
    b = sorted({i for i in range(1, n) if (i in a) == (rng.random() < 0.95)} | ({n} if n else set()))
    to_a, to_b = token_alignment.groups_of(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in to_a] == common == [b[j - 1] for j in to_b]


def test_one_to_one_stretches_are_jumped():
    ends = list(range(1, 5001))

    class Counting(list):
        reads = 0

        def __getitem__(self, i):
            Counting.reads += 1
            return super().__getitem__(i)

    assert token_alignment.align(Counting(ends), ends) == ([5000], [5000], [1])
    assert Counting.reads < 40


def _trie_by_lists(rows, group=5, spread=9):
    conv = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    # equal turns: in order of their digests
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    own = {c: [(r, t) for _, _, _, r, t in sorted((n, k, digest(r, t), r, t) for n, k, r, t in ts)] for c, ts in conv.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % spread
        turns = own.get(c - int(math.fmod(c, group)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            n = nodes.setdefault(tuple(turns[:d]), {"in": [], "end": [], "kids": set()})
            n["in"].append(c)
            if d == len(turns):
                n["end"].append(c)
            if d:
                nodes[tuple(turns[: d - 1])]["kids"].add(turns[d - 1])
    out = []
    for p, n in nodes.items():
        under = [(q, m) for q, m in nodes.items() if q[: len(p)] == p]
        saved = sum((len(m["in"]) - 1) * len(q[-1][1].encode()) for q, m in under if q)
        ends = ",".join(map(str, sorted(n["end"])))
        out.append((min(n["in"]), len(p), min(nodes[p[:-1]]["in"]) if p else None, len(n["in"]), len(n["kids"]), sum(not m["kids"] for _, m in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _nodes(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def _conversations():
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ua"), f"text é{rng.randint(0, 2)}") for c in range(60) for t in range(rng.choice([1, 2, 3, 5, 30]))]
    rows += [(c, t, "u", f"copy {t}") for c in range(1000, 1120) for t in range(12)]  # one conversation many times
    rows += [(7, 1, "u", "again"), (7, 1, "u", "again"), (8, None, "u", "no turn"), (9, 2, None, None), (9, 3, "", ""), (None, 0, "u", "nobody"), (-3, 0, "u", "below zero"), (2001, 0, "a", "|,'")]
    return rows


@pytest.mark.parametrize(("shard_turns", "length"), [(60, 4), (10**6, 256)])
def test_trie_equals_brute_force(spark, shard_turns, length):
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n int, key string").repartition(3)
    pieces = staged(prefix_trie.pieces_of(df, shard_turns), "pieces")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    got = _nodes(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(pieces, 5, h, 8), shard_turns, length))
    assert got == _trie_by_lists(rows)


def test_trie_of_a_long_conversation_and_of_none(spark):
    rows = [(0, t, "u", f"t{t}") for t in range(700)] + [(1, t, "u", f"t{t}") for t in range(650)]
    schema = "conv_id long, turn long, role string, text string"
    got = _nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, schema), shard_turns=500))
    assert got == _trie_by_lists(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []


def test_medians_balance_the_tree():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.medians(1023):
        tree.insert([i], i)

    def height(v):
        return 1 + max(height(tree.less[v]), height(tree.more[v])) if v else 0

    assert sorted(prefix_trie.medians(1023)) == list(range(1023))
    assert height(tree.down[0]) == 10


RULES = queries.RULES
URLS = [
    None, "", "no scheme", "://", "http://", "http://Example.ORG/es/1", "http://a.example.org/es/1", "http://example.org/en/1", "http://x.example.org/en/199?q#f", "http://example.org/en/2", "http://notexample.org/es/5", "http://org/", "http://org", "http://a.org?x=/es/", "http://b.com/fr/#/de/",
    "http://b.com/fr", "http://b.com/de/7", "http://com/de/", "http://x.communism.net/de/1", "http://Ünï.net/en/5", "HTTP://U:P@h.com:80/fr/1", "a://b.net/c://d.org/es/1", "http://é.ORG/\nline", "http://n.net/en/1?a=http://x.org/", "http://h.net" + "/deep" * 40,
]


def _rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, after = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after] or [len(after)])]
    fits = [(len(t), t, v) for v, t in RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def _templates_by_dicts(pages):
    """The tree of each host level by level in dictionaries: (host, template, plain) of every (host, path, label)."""
    paths = [[s for s in p.split("/") if s][: url_templates.DEPTH] for _, p, _ in pages]
    wild = lambda s: "#" if re.search(url_templates._DIGITS, s) else "*"
    template, plain = [""] * len(pages), [""] * len(pages)
    for d in range(max(map(len, paths), default=0)):
        here = [i for i, p in enumerate(paths) if len(p) > d]
        own, total, every = collections.Counter(), collections.Counter(), collections.Counter()
        for i in here:
            s = paths[i][d]
            total[pages[i][0], template[i]] += 1
            if wild(s) == "*":
                own[pages[i][0], template[i], s] += 1
                every[s] += 1
        least, share = url_templates.LEAST, url_templates.SHARE
        names, groups = {}, collections.defaultdict(dict)
        for i in here:
            h, t, s = pages[i][0], template[i], paths[i][d]
            stays = own[h, t, s] >= max(least, share * total[h, t]) or every[s] >= max(least, share * len(here))
            names[i] = "/" + s if stays else wild(s)
            b = groups[h, t].setdefault(names[i], {"name": names[i], "labelled": 0, "blocked": 0, "next": collections.Counter()})
            b["labelled"] += pages[i][2] is not None
            b["blocked"] += pages[i][2] or 0
            left = len(paths[i]) - d - 1
            b["next"][f"{left}{wild(paths[i][d + 1])}" if left else "0"] += 1
        merged = {k: url_templates.merge_branches(list(g.values())) for k, g in groups.items()}
        for i in here:
            template[i], plain[i] = template[i] + ">" + merged[pages[i][0], template[i]][names[i]], plain[i] + ">" + names[i]
    return [(p[0], t, q) for p, t, q in zip(pages, template, plain, strict=True)]


def _judged(pages):
    out, urls = [], [_rule(u) for _, u in pages]
    keys = _templates_by_dicts([(h, p, {"block": 1, "allow": 0}.get(v)) for h, p, _, v in urls])
    all_, wide, own = [0, 0], collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for (h, t, q), (*_, v) in zip(keys, urls, strict=True):
        for c in (all_, wide[q], own[h, t]):
            c[0] += v is not None
            c[1] += v == "block"
    base, w = (all_[1] + 1) / (all_[0] + 2), url_templates.WEIGHT
    for (i, _), (host, path, rule, verdict), (h, t, q) in zip(pages, urls, keys, strict=True):
        prior = (wide[q][1] + w * base) / (wide[q][0] + w)
        purity = (own[h, t][1] + w * prior) / (own[h, t][0] + w)
        out.append((i, host, path, rule, verdict or ("block" if purity >= url_templates.REJECT else "allow"), t, round(purity, 9)))
    return sorted(out, key=str)


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["en", "de", "fr", "es", "blog", "tag"]
    urls = list(URLS)
    for _ in range(900):
        host = rng.choice(["big.net"] * 6 + ["a.example.org", "b.com", "c.com", "d.net", f"h{rng.randint(0, 30)}.net"])
        parts = [rng.choice(words[:4]), *[rng.choice([rng.choice(words), str(rng.randint(1, 999)), f"{rng.randint(1, 99)}.html", f"slug-{rng.randint(0, 400)}", "deadbeef00"]) for _ in range(rng.randint(0, 3))]]
        urls.append(f"http://{host}/" + "/".join(parts) + rng.choice(["", "/", "?q=1", "#x"]))
    pages = [*enumerate(urls), (None, "http://big.net/en/1"), (None, "http://big.net/en/1")]
    df = spark.createDataFrame([(i, u, 1, "x", 2) for i, u in pages], "page_id long, url string, part int, template string, label int").repartition(3)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in url_templates.judge(df, RULES).collect()), key=str)
    assert got == _judged(pages)


def test_url_filter_learns_from_the_rules(spark):
    urls = [f"http://a.example.org/es/{i}" for i in range(40)] + [f"http://b.org/en/{i + 200}" for i in range(40)] + [f"http://c.net/{lang}/{i}" for lang in ("es", "en") for i in range(20)]
    out = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES)
    got = {(r.host, r.path.split("/")[1], r.verdict) for r in out.collect()}
    assert got == {("a.example.org", "es", "block"), ("b.org", "en", "allow"), ("c.net", "es", "block"), ("c.net", "en", "allow")}
    assert url_templates.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_branches_that_differ_stay_apart():
    b = lambda name, labelled, blocked, **next_: {"name": name, "labelled": labelled, "blocked": blocked, "next": next_}
    assert url_templates.merge_branches([b("/a", 50, 1, x=50), b("/b", 50, 2, x=50), b("/c", 50, 49, x=50), b("/d", 0, 0, x=50)]) == {"/a": "/a|/b", "/b": "/a|/b", "/c": "/c", "/d": "/d"}
    assert url_templates.merge_branches([b("/a", 0, 0, x=90, y=10), b("/b", 0, 0, x=10, y=90), b("/c", 0, 0, x=88, y=12)]) == {"/a": "/a|/c", "/c": "/a|/c", "/b": "/b"}
