import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealerlens.llm import components, kneser_ney, near_dup, topk, toxicity

from .helpers import documents, odd_texts, with_clashes


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def words_of(x):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(x)) if w]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, x) for x in range(2001, 2100)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.id: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def plain_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * n >= num * (len(sets[i]) + len(sets[j]) - n) and label[i] != label[j]:
                a, b = max(label[i], label[j]), min(label[i], label[j])
                label = [b if x == a else x for x in label]
    return label, [len(s) for s in sets]


def family_texts(seed=4, families=12, copies=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randrange(4, 120))]
        for _ in range(r.randrange(1, copies)):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t).title() if r.random() < 0.2 else "\n".join(t))
    return texts


@pytest.mark.parametrize("k,threshold", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_equal_brute_force(spark, k, threshold):
    texts = family_texts() + odd_texts()
    label, sizes = plain_groups(texts, k, *threshold)
    got = near_dup.near_duplicates(with_clashes(documents(spark, texts), "set_key", "component"), k=k, threshold=threshold).orderBy("doc_id").collect()
    assert [(r.component_id, r.n_shingles, r.kept) for r in got] == [(c, n, c == i) for i, (c, n) in enumerate(zip(label, sizes, strict=True))]


def test_large_families_in_blocks_and_regions(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FAMILY_SHINGLES", 600)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dup, "REGION", 5)
    r = random.Random(9)
    base = [f"w{r.randrange(300)}" for _ in range(100)]
    texts = []
    for i in range(40):  # a star: copies are linked with the base more than with each other
        t = list(base)
        for _ in range(0 if i == 0 else 3):
            t[r.randrange(100)] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(t))
    label, _ = plain_groups(texts, 3, 85, 100)
    got = near_dup.near_duplicates(documents(spark, texts), k=3, threshold=(85, 100)).orderBy("doc_id").collect()
    assert [x.component_id for x in got] == label


def test_regions_that_are_cut_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "REGION", 3)
    r = random.Random(11)
    shared = [f"s{i}" for i in range(60)]  # all texts share it, so that regions are large, but most stay unlinked
    texts = []
    for i in range(70):
        texts.append(" ".join(shared + [f"own{i}x{j}" for j in range(18)]))
        if i % 5 == 0:
            words = texts[-1].split()
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    r.shuffle(texts)
    label, _ = plain_groups(texts, 3, 85, 100)
    assert 10 <= len(texts) - len(set(label))
    got = near_dup.near_duplicates(documents(spark, texts), k=3, threshold=(85, 100)).orderBy("doc_id").collect()
    assert [x.component_id for x in got] == label


def test_stretches_end_at_the_shortest_common_prefix():
    rest = [0x01010101, 0x01010102, 0x01010203, 0x02010101, 0x02010102, 0x02010103]
    rows = [(1, 0, 9), *((2, x, i) for i, x in enumerate(rest)), (3, 0, 7)]
    got = list(near_dup._stretches(iter(rows), 4))
    assert [(p, [i for _, i in part], whole) for p, part, whole in got] == [(1, [9], False), (2, [0, 1, 2], False), (2, [3, 4, 5], False), (3, [7], False)]
    assert [near_dup.common_prefix(a, b) for a, b in ((5, 5), (5, 6), (0x0100, 0x0200), (1 << 24, 2 << 24))] == [4, 3, 2, 0]
    assert [whole for _, _, whole in near_dup._stretches(iter([(1, 0, 1), (2, 0, 2), (2, 0, 3), (3, 0, 4)]), 4)] == [False, True, False]


def test_texts_of_one_id_are_one_document(spark):
    base = [f"w{i}" for i in range(40)]
    near = lambda words, at: " ".join([*words[:at], "x", *words[at + 1 :]])
    other = [f"v{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(other), near(base, 39), near(other, 39), "", " ".join(other), "alone"]
    docs = documents(spark, texts, ids=[2, 3, 5, 5, 5, 9, 11])
    got = near_dup.near_duplicates(docs, k=3, threshold=(85, 100)).collect()
    assert {(x.doc_id, x.component_id, x.kept) for x in got} == {(2, 2, True), (3, 2, False), (5, 2, False), (9, 2, False), (11, 11, True)}
    kept = near_dup.drop_near_duplicates(docs, k=3, threshold=(85, 100))
    assert sorted(x.doc_id for x in kept.collect()) == [2, 11]


def test_near_duplicate_odd_tables(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    got = near_dup.near_duplicates(documents(spark, ["a b c", "a b c", None, "a b c"], ids=[3, 3, 4, None])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (4, 4, True), (None, 3, True)} or {(r.doc_id, r.kept) for r in got} == {(3, True), (4, True), (None, True)}
    kept = near_dup.drop_near_duplicates(documents(spark, ["a b c d e f", "x", "a b c d e f"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]


@pytest.mark.parametrize("per_range", [50, 4_000_000])
def test_kneser_ney_against_plain_python(spark, monkeypatch, per_range):
    monkeypatch.setattr(kneser_ney, "TOKENS_PER_RANGE", per_range)
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(1))}" for _ in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) for _ in range(80)] + odd_texts()
    tokens = [[*words_of(t), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c, b = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            b.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    history, classes, follow = Counter(), defaultdict(Counter), Counter()
    for (x, y), k in b.items():
        history[x] += k
        classes[x][min(k, 3)] += 1
        follow[y] += 1
    of = lambda counts: (0.0, *kneser_ney.discounts(np.bincount(np.minimum(list(counts.values()), 5), minlength=6)))
    d2, d1 = of(b), of(follow)
    rest = sum(d1[min(k, 3)] for k in follow.values()) / len(b)
    lower_p = lambda w: max(follow[w] - d1[min(follow[w], 3)], 0) / len(b) + rest / (v + 1)

    def p(x, w):
        if x not in history:
            return lower_p(w)
        return max(b[x, w] - d2[min(b[x, w], 3)], 0) / history[x] + sum(d2[i] * k for i, k in classes[x].items()) / history[x] * lower_p(w)

    assert sum(p("<s>", w) for w in c) + p("<s>", "unseen") == pytest.approx(1)
    docs = documents(spark, texts)
    got = kneser_ney.score(with_clashes(docs, "score"), kneser_ney.train(docs)).orderBy("doc_id").collect()
    for t, h, row in zip(tokens, held, got, strict=True):
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (h, len(t), sum(c[w] > 0 for w in t), n)
        assert row.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert row.score == pytest.approx(sum(math.log10(p(x, w)) for x, w in zip(["<s>", *t[:-1]], t, strict=True)), rel=1e-6)


def test_language_model_rows_hold_few_keys(spark, monkeypatch):
    r = random.Random(9)
    docs = documents(spark, [" ".join(f"w{int(r.paretovariate(1))}" for _ in range(r.randrange(60))) for _ in range(60)] + odd_texts())
    whole = kneser_ney.score(docs, kneser_ney.train(docs)).orderBy("doc_id").collect()
    monkeypatch.setattr(kneser_ney, "KEYS_PER_ROW", 3, raising=False)
    model = kneser_ney.train(docs)
    for place in (model.words, model.pairs, model.contexts, model.continued):
        sizes = [(x.n, len(x.a)) for x in spark.read.parquet(place).select("n", "a").collect()]
        assert max(sizes) == (3, 24) and len(sizes) > 3
        keys = np.concatenate([np.frombuffer(x.a, np.uint64) for x in spark.read.parquet(place).select("a").collect()])
        assert len(np.unique(keys)) == len(keys)  # a history's statistics are never cut in two
    for step in (1, 40):  # texts are scored one by one, or some at a time
        monkeypatch.setattr(kneser_ney, "STEP", step)
        assert kneser_ney.score(docs, model).orderBy("doc_id").collect() == [pytest.approx(row) for row in whole]


def test_counting_pairs_holds_few_bytes_a_token():
    r = np.random.default_rng(1)
    vocabulary = np.unique(r.integers(0, 2**63, 50_000).astype(np.uint64))
    words = kneser_ney.Ranges.__new__(kneser_ney.Ranges)
    counts = np.full(len(vocabulary), 20)
    words.keys, words.starts = vocabulary, np.asarray([0, len(vocabulary)])
    words.columns = {"a": vocabulary, "b": counts, "d": np.cumsum(counts) - counts}
    held = [r.choice(vocabulary, 1000) for _ in range(500)]
    number = {int(w): i for i, w in enumerate(vocabulary, start=1)}
    expected = Counter(x for t in held for x in zip([0, *map(number.get, t[:-1].tolist())], map(number.get, t.tolist()), strict=True))
    got, ranges = Counter(), []
    tracemalloc.start()
    try:
        keys, times = kneser_ney._distinct([kneser_ney._pair_keys(words, held)])
        batches = kneser_ney._blob_batches(kneser_ney._by_range(keys, times, kneser_ney._pair_ranges(words, keys, 100_000)))
        for batch in batches:
            assert batch.nbytes < 3 * kneser_ney.BATCH_BYTES
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not held and peak < 100 * 500_000  # 130 bytes a token before
    for number, k, c in kneser_ney._by_range(keys, times, kneser_ney._pair_ranges(words, keys, 100_000)):
        k = np.frombuffer(k, np.uint64)
        ranges.append(number)
        got.update(dict(zip(zip((k >> np.uint64(32)).tolist(), (k & np.uint64(2**32 - 1)).tolist(), strict=True), np.frombuffer(c, np.uint8).tolist(), strict=True)))
    assert got == expected and ranges == sorted(set(ranges)) and len(ranges) > 3


def test_language_model_without_training_rows(spark):
    empty = documents(spark, [])
    model = kneser_ney.train(empty)
    assert kneser_ney.score(empty, model).count() == 0
    row = kneser_ney.score(documents(spark, ["a b"]), model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def labelled(spark, n=400):
    r = random.Random(11)
    plain, bad = [f"tha{i}on" for i in range(200)], ["vexqu", "vexji", "vexro"]
    texts, toxic = [], []
    for i in range(n):
        t = [r.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            t[r.randrange(60)] = r.choice(bad) + r.choice(("a", "o", "tion"))
        texts.append(" ".join(t))
        toxic.append(int(i % 4 == 0))
    return documents(spark, texts), spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int"), toxic


def test_toxicity_held_out_accuracy_and_repeats(spark):
    docs, labels, toxic = labelled(spark)
    model = toxicity.train(docs, labels)
    got = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(len(toxic))]
    assert all((s >= 0.5) == bool(y) for s, y, f in zip(got, toxic, fold, strict=True) if f == 0)
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin([i for i, f in enumerate(fold) if f == 0]), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(docs, flipped).weights, model.weights)


def balanced(n, terms, seed):
    """n plain texts and n with one of the given number of toxic terms."""
    fixed, r = random.Random(1), random.Random(seed)
    word = lambda parts, low, high: "".join(fixed.choice(parts) for _ in range(fixed.randrange(low, high)))
    plain = [word(("ka", "lo", "mi", "ten", "dra", "sul", "por", "ne", "vi", "gra", "ost", "eb"), 2, 5) for _ in range(2000)]
    bad = [word([c + v for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou"], 4, 5) for _ in range(terms)]
    texts = [[r.choice(plain) for _ in range(60)] for _ in range(2 * n)]
    for t in texts[1::2]:
        t[r.randrange(60)] = r.choice(bad)
    return [" ".join(t) for t in texts], [0, 1] * n


@pytest.mark.parametrize("n,terms,least", [(50, 10, 0.65), (300, 100, 0.7), (3000, 100, 0.99)])
def test_toxicity_of_balanced_samples_with_rare_terms(n, terms, least):
    model = toxicity.fit(*balanced(n, terms, 5))
    texts, labels = balanced(500, terms, 6)
    right = [(model.score(t) >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True)]
    assert sum(right) >= least * len(right), sum(right)


def test_toxicity_fit_beyond_what_it_holds(monkeypatch):
    texts, labels = balanced(100, 10, 5)
    whole = toxicity.fit(texts, labels).weights
    monkeypatch.setattr(toxicity, "HELD", 1000)
    assert np.array_equal(toxicity.fit(texts, labels).weights, whole)


def test_toxicity_odd_rows(spark):
    docs, labels, _ = labelled(spark, 60)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(with_clashes(documents(spark, odd_texts()), "Score"), model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows[:3]}) == 1
    none = toxicity.train(docs, labels.filter("toxic = 5"))
    assert none.score("x") == pytest.approx(0.5)
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_bit_sliced_block_equals_matrix():
    r = np.random.default_rng(5)
    for width, spread in ((8, 300), (1, 2), (16, 5)):
        values = r.integers(-spread, spread, (150, width))
        ids = np.concatenate([r.permutation(140), np.arange(10)])
        block = topk.SlicedBlock(ids, values)
        for _ in range(5):
            q = r.integers(-spread, spread, width)
            slices, base = block.weighted_sum(q)
            sums = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:150].astype(int) << i for i, s in enumerate([*slices, np.zeros(block.words, np.uint64)])) + base
            assert np.array_equal(sums, block.values @ q)
            own = int(ids[3])
            want = sorted(((-int(v @ q), int(i)) for i, v in zip(ids, values, strict=True) if i != own))[:7]
            assert block.top(q, 7, own) == [(i, -s) for s, i in want]


def test_top_k_over_blocks_and_odd_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (350, rows[0][1]), (400, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.exact_top_k(df, df.filter("vec_id % 50 = 0"), rows_per_block=32, rows_per_group=64).orderBy("query_id", "rank").collect()
    good = {i: np.pad(np.floor(256 * np.asarray(v)), (0, 6 - len(v))).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in good if i % 50 == 0):
        best = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert [tuple(x) for x in got] == want
    assert topk.exact_top_k(df.filter("false"), df.filter("false")).count() == 0


def test_top_k_of_repeated_ids_and_large_components(spark):
    nan = float("nan")
    rows = [(50, [nan, 1.0]), (50, [1.0, 2.0]), (50, [2.0, 0.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0]), (3, [2.0**40, 1.0]), (100, [2.0**300, -1.0]), (4, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk.exact_top_k(df, df.filter("vec_id % 50 = 0"), rows_per_block=2, rows_per_group=4).orderBy("query_id", "rank").collect()]
    least, asked = {50: [1, 2], 100: [2**300, -1]}, {}
    exact = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b, strict=False))
    for q, v in least.items():
        every = sorted(((-exact([int(x * 256) / 256 for x in w], v), i) for i, w in rows if i != q and nan not in w and w[0] == w[0]))
        asked[q] = [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(every[:5])]
    assert [x for x in got if x[0] == 50] == asked[50]
    assert [(x[0], x[1], x[3]) for x in got if x[0] == 100] == [(q, n, s) for q, n, _, s in asked[100]]
