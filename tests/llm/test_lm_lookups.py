"""The scorer looks an n-gram up once per slice, words are counted and numbered whole, and Arrow's words are those of ``bytes.lower().split()``."""

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import ngram_lm
from quern.staging import Stages


def test_repeated_n_grams_are_looked_up_once(spark, monkeypatch):
    text = "a b c d " * 500
    rows = spark.createDataFrame([(text,), ("b c x",), ("a b y",)], "text string")
    scorer = ngram_lm.Scorer(ngram_lm.train(rows, Stages(spark, "t")))
    asked, find = [], ngram_lm.find
    monkeypatch.setattr(ngram_lm, "find", lambda index, key: asked.append(len(key)) or find(index, key))
    got = scorer(pa.array([text, None, text + "z z z z"]))
    assert got["n_tokens"].tolist() == [2001, 1, 2005] and got["n_known"].tolist() == [2001, 1, 2001]
    assert np.isfinite(got["score"]).all() and sum(asked) < 100


def test_only_distinct_n_grams_are_dealt_over_parts(spark, monkeypatch):
    rows = spark.createDataFrame([("a b c d " * 500,), ("b c x",)], "text string")
    scorer = ngram_lm.Scorer(ngram_lm.train(rows, Stages(spark, "t")))
    dealt, part = [], ngram_lm._part
    monkeypatch.setattr(ngram_lm, "_part", lambda context, key, hot, parts: dealt.append(len(key)) or part(context, key, hot, parts))
    got = scorer(pa.array(["a b c d " * 500, "b c x"]))
    assert got["n_tokens"].tolist() == [2001, 4] and sum(dealt) < 100


def test_order_of_numbers_that_differ_in_their_last_bits():
    r = np.random.default_rng(4)
    few = np.r_[r.integers(0, 1 << 64, 5000, np.uint64), np.arange(90, dtype=np.uint64)[::-1], np.uint64(1 << 63) + r.integers(0, 9, 50, np.uint64)]
    for key in (few, r.integers(0, 1 << 12, 9000, np.uint64), few[:1], few[:0]):
        order, ordered = ngram_lm._order(key)
        assert (ordered == np.sort(key)).all() and (key[order] == ordered).all() and (np.sort(order) == np.arange(len(key))).all()


def test_words_are_counted_across_sums_and_flushes(spark):
    name = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = [name(0, 300_000)] * 3 + [name(300_000, 800_000), name(0, 300_000), "w0 w799999 W0"]
    got = {x["n"]: x["count"] for x in ngram_lm.count_words(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).groupBy("n").count().collect()}
    assert got == {1: 499_999, 2: 1, 4: 299_999, 6: 3}  # w799999; w0, END and START


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary(), pa.large_binary()])
def test_words_of_odd_texts(kind):
    texts = [b" A  b\x0bc\x1fd\xc2\xa0E\t", None, b"", b"\r\n ", "İ ß X\0y".encode(), b"x \xff X" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else b"x X", b"a"]
    column = pa.array([None, *texts], pa.binary() if kind in (pa.string(), pa.binary()) else pa.large_binary()).view(kind)
    words = ngram_lm.Words(column[1:])
    want = [(t or b"").lower().split() for t in texts]
    assert words.sizes.tolist() == [len(w) for w in want]
    assert [words.distinct[k] for k in words.number] == [x for w in want for x in w]
    assert len(set(words.distinct)) == len(words.distinct)
    assert ngram_lm.Words(column[:0]).sizes.tolist() == []
