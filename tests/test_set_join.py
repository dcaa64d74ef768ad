"""The set joins write no pairs, and blocks, copies and ids of any kind leave none out."""

import random

import pytest
from pyspark.sql import functions as F

from quern import staging
from quern.operators import similarity
from quern.plans.catalogue import QUERIES
from tests.test_operators import rows


def held(spark, tmp_path, monkeypatch, join, sets):
    """Bytes that a join leaves in the shared folder, and its rows."""
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    got = rows(join(sets, 0.5))
    return sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()), got


def near_misses(spark):
    """3000 sets of 20 of 60 items: most pairs meet, next to none is similar."""
    r = random.Random(5)
    base = [(k, r.sample(range(60), 20)) for k in range(3000)]
    return spark.createDataFrame(base, "id long, items array<long>").select("id", F.explode("items").alias("item"))


def brute_force(base):
    return sorted((a, b) for a in base for b in base if a < b and len(base[a] & base[b]) >= 0.5 * len(base[a] | base[b]))


def test_exact_join_writes_no_pairs_that_are_not_similar(spark, tmp_path, monkeypatch):
    size, got = held(spark, tmp_path, monkeypatch, similarity.jaccard_pairs, near_misses(spark))
    assert size < 1_000_000 and all(s >= 0.5 for _, _, s in got)


@pytest.mark.parametrize("as_text", [False, True])
def test_exact_join_over_many_blocks(spark, monkeypatch, as_text):
    monkeypatch.setattr(similarity.set_join, "SMALL", 40)
    r = random.Random(3)
    base = {k: frozenset(r.sample(range(40), r.choice((1, 2, 3, 5, 8, 13, 21)))) for k in range(-100, 100)}
    copies = {300 + k: base[k] for k in range(0, 100, 9)}  # each is joined with its class only
    key = (lambda k: f"{k + 100:03d}") if as_text else (lambda k: k)
    kind = "string" if as_text else "int"
    whole = [(key(k), x) for k, s in (base | copies).items() for x in s]
    first = {}
    for k in sorted(base | copies):
        first.setdefault((base | copies)[k], k)
    reps = {k: s for s, k in first.items()}
    want = sorted({(key(a), key(b)) for a, b in brute_force(reps)} | {(key(first[s]), key(k)) for k, s in (base | copies).items() if first[s] != k})
    got = similarity.jaccard_pairs(spark.createDataFrame(whole, f"id {kind}, item long").repartition(7), 0.5)
    assert rows(got, "a", "b") == want and dict(got.dtypes)["a"] == kind


@pytest.mark.parametrize("name", ["jaccard_exact_pairs", "jaccard_lsh_pairs"])
def test_rows_of_one_id_are_one_set(spark, tmp_path, name):
    docs = [(1, "a b"), (1, "b c d"), (2, "a b c  D"), (3, "a b c x"), (4, None), (5, " "), (None, "a b c d")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES[name](spark, str(tmp_path))) == [(1, 2, 1.0), (1, 3, 0.6)]


def test_lsh_join_writes_its_bands_but_no_pairs(spark, tmp_path, monkeypatch):
    size, got = held(spark, tmp_path, monkeypatch, similarity.lsh_pairs, near_misses(spark))
    assert size < 2_500_000 and all(s >= 0.5 for _, _, s in got)
