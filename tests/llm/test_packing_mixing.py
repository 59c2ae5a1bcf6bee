import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dealerlens.llm import mixing, packing

from .helpers import documents, odd_texts, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 20))
def test_packer_keeps_bins_within_capacity_and_gapless(lengths, open_bins):
    p, used = packing.BestFitPacker(64, open_bins), defaultdict(int)
    for n in lengths:
        number, offset = p.place(n)
        assert offset == used[number]
        used[number] += n
        assert used[number] <= 64 and p.n_open <= open_bins


def test_packer_is_best_fit():
    p = packing.BestFitPacker(10)
    assert [p.place(n)[0] for n in (7, 6, 5)] == [0, 1, 2]
    assert p.place(4) == (1, 6) and p.place(3) == (0, 7)
    p = packing.BestFitPacker(10, open_bins=2)
    for n in (9, 6, 7):
        p.place(n)  # the third bin closes the fullest, that of 9
    assert p.place(1)[0] == 2


@settings(deadline=None)
@given(st.integers(1, 5000), st.integers(1, 1024))
def test_cut(length, capacity):
    pieces = packing.cut(length, capacity)
    assert sum(n for _, n in pieces) == length and all(n == capacity for _, n in pieces[1:]) and [s for s, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces[:-1]]))


@settings(deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_tokenizers(text):
    assert packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 700_000, " \n\t" * 300_000 + "end", "a" * 2_000_000, "x" + " " * 1_100_000 + "y", "!" * 300_000], ids=["spaces", "lines", "mixed", "letter", "gap", "marks"])
def test_encoder_long_runs(text):
    assert packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_encoder_special_string_and_other_files():
    for text in ("a <|endoftext|> b", "  x   y\n\n z"):
        assert packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(other)("Hello there").tolist() == Tokenizer.from_file(other).encode("Hello there", add_special_tokens=False).ids


def test_pack_round_trip(spark):
    texts = odd_texts()
    rows = packing.pack_documents(with_clashes(documents(spark, texts), "ids", "piece", "offset"), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert [r.length for r in own[1:]] == [1024] * (len(own) - 1) and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 1024
    assert len(bins) <= sum(r.length for r in rows) // 1024 + 2


def test_op1_columns_and_empty(spark, sf_dir):
    df = packing.op1_best_fit_packing(spark, sf_dir)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = df.collect()
    assert len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    assert packing.ids_crc32(np.asarray([1, 2], np.uint32)) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0
    assert json.loads(df.schema.json())


def test_mixing_reaches_target_rates(spark):
    n = 4000
    sources = ["hot" if i % 3 else (None if i % 2 else "rare") for i in range(n)]
    docs = documents(spark, ["t"] * n, sources=sources)
    got = Counter(r.source for r in mixing.mix(docs, weights={"hot": 1.0, "rare": 3.0}).collect())
    rates = {r.source: (r.n_docs, r.repetition_rate) for r in mixing.source_rates(docs, weights={"hot": 1.0, "rare": 3.0}).collect()}
    assert sum(n * x for n, x in rates.values()) == pytest.approx(n)
    for source, (count, rate) in rates.items():
        assert abs(got[source] - count * rate) < 5 * (count * rate) ** 0.5
    assert rates["rare"][0] * rates["rare"][1] == pytest.approx(3 * rates["hot"][0] * rates["hot"][1])


def test_poisson_inverse_against_the_distribution(spark):
    import math

    from pyspark.sql import functions as F

    for rate in (0.05, 0.9, 3.0, 31.0):
        cum, term, want = 0.0, math.exp(-rate), {}
        for k in range(200):
            cum += term
            want[k] = cum
            term *= rate / (k + 1)
        us = [0.0, 0.01, 0.3, 0.77, 0.999]
        got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_inverse(F.col("u"), F.lit(rate)).alias("n")).collect()
        assert [r.n for r in got] == [min(k for k, c in want.items() if c > u) for u in us]


@pytest.mark.parametrize("rate", [33.0, 300.0, 511.9, 513.5, 5000.0])
def test_poisson_inverse_of_high_rates(spark, rate):
    import math

    from pyspark.sql import functions as F

    n = 2000
    us = [(i + 0.5) / n for i in range(n)]
    got = [r.n for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_inverse(F.col("u"), F.lit(rate)).alias("n")).collect()]
    low, high = int(max(0, rate - 12 * rate**0.5)), int(rate + 12 * rate**0.5)
    cum = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(low, high)])
    want = low + np.searchsorted(cum, us, side="right")
    assert np.array_equal(got, want)
    assert np.mean(got) == pytest.approx(rate, rel=1e-3) and np.var(got) == pytest.approx(rate, rel=0.02)


def test_mixing_of_a_small_source_beside_a_large_one(spark):
    docs = documents(spark, ["t"] * 4040, sources=["small"] * 40 + ["large"] * 4000)
    weights = {"small": 2.0, "large": 1.0}  # the small source's rate is 67
    copies = Counter(r.doc_id for r in mixing.mix(docs, weights=weights).filter("source = 'small'").collect())
    rate = next(r.repetition_rate for r in mixing.source_rates(docs, weights=weights).collect() if r.source == "small")
    assert 0.4 * rate < np.var(list(copies.values())) < 2 * rate and min(copies.values()) < rate - 16


def test_mixing_odd_rows(spark):
    docs = documents(spark, odd_texts(), ids=[None, 1, 2, 3, 3, 5, 6], sources=[None, "a", "a", "b", "b", "b", "b"])
    a = mixing.mix(with_clashes(docs, "copy", "extra"), temperature=1.0).collect()
    assert Counter((r.doc_id, r.copy) for r in a) == Counter((r.doc_id, r.copy) for r in mixing.mix(docs.repartition(3), temperature=1.0).collect())
    assert set(mixing.mix(docs).columns) == {*docs.columns, "repetition_rate", "copy", "shuffle_key"} and all(r.extra == "clash" for r in a)
    assert mixing.mix(documents(spark, [])).count() == 0
