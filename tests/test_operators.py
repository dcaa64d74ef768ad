"""Hand-made cases with results worked out on paper, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cluster, explore, graph, itemsets, recommend, similarity, sketches
from quern.operators.components import connected_components
from quern.sources import readers, sinks
from quern.streaming import jobs


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_truthy_ids_and_ties(spark):
    df = spark.createDataFrame([("", "2018-01-01", "b", "x"), (None, "2017", "a", "x"), ("r", "2018-02", "a", "y"), ("s", None, "b", None)], "id string, date string, u string, i string")
    assert rows(explore.summary(df, "id", "date", "u", "i", "2018")) == [(2, 2, 2, 2)]
    assert [tuple(r) for r in explore.top(df, "u", 1).collect()] == [("a", 2)]


def test_partitions_beyond_the_buckets_are_empty(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = dict(rows(explore.partition_stats(df, "k", 101)))
    assert len(got) == 101 and got[100] == 0 and sum(got.values()) == 1000
    assert sum(n for _, n in rows(explore.physical_partitions(df, 5))) == 1000


def test_groups_without_facts_are_absent(spark):
    facts = spark.createDataFrame([(1, 4.0), (1, 2.0)], "k int, v double")
    dims = spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string")
    assert rows(explore.grouped_average(facts, dims, "k", "g", "v")) == [("a", 3.0)]


BASKETS = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "c"), ("3", "a"), ("3", "a")]


def test_itemsets_of_three_baskets(spark):
    pairs = itemsets.baskets(spark.createDataFrame(BASKETS, "b string, i string"), "b", "i")
    want = [(["a"], 3), (["a", "b"], 2), (["b"], 2)]
    assert rows(itemsets.frequent_itemsets(pairs, 2)) == want
    assert rows(itemsets.fp_growth(pairs, 2)) == want
    assert rows(itemsets.son_itemsets(pairs, 2, 2)) == want
    assert rows(itemsets.baskets(pairs, "basket", "item", larger_than=2), "basket") == [("2",)] * 3
    assert rows(itemsets.frequent_itemsets(pairs.limit(0), 2)) == []


def test_itemset_methods_agree(spark):
    r = random.Random(5)
    pairs = spark.createDataFrame([(b, i) for b in range(60) for i in r.sample(range(12), r.randint(1, 7))], "basket long, item long")
    want = rows(itemsets.frequent_itemsets(pairs, 8))
    assert want and want == rows(itemsets.fp_growth(pairs, 8)) == rows(itemsets.son_itemsets(pairs, 8, 3))


def test_retail_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('﻿"DATE","CUSTOMER","A","B","C","PRODUCT"\r\n"11/1/2000","0123","x","y, z","w","0004"\r\n'.encode())
    df = readers.read_csv(spark, str(path), "date string, customer string, a string, b string, c string, product string")
    assert rows(itemsets.retail_pairs(df, "date", "customer", "product")) == [("11/1/00-0123", "4")]


def test_jaccard_at_the_threshold(spark):
    sets = spark.createDataFrame([(k, x) for k, s in enumerate(("123", "234", "9", "39")) for x in s], "id long, item string")
    for f in (similarity.jaccard_pairs, similarity.lsh_pairs):
        assert rows(f(sets, 0.5)) == [(0, 1, 0.5), (2, 3, 0.5)]
        assert rows(f(sets.limit(0), 0.5)) == []


def test_jaccard_equals_brute_force(spark):
    r = random.Random(2)
    base = {k: set(r.sample(range(30), r.randint(1, 12))) for k in range(60)}
    want = sorted((a, b) for a in base for b in base if a < b and len(base[a] & base[b]) / len(base[a] | base[b]) >= 0.5)
    sets = spark.createDataFrame([(k, x) for k, s in base.items() for x in s], "id long, item long")
    assert rows(similarity.jaccard_pairs(sets, 0.5), "a", "b") == want == rows(similarity.lsh_pairs(sets, 0.5), "a", "b")


def ratings(spark, data):
    return spark.createDataFrame([(u, i, float(s)) for u, i, s in data], "user long, item long, stars double")


def test_pearson_gate_and_constant_vectors(spark):
    data = [(u, i, u * i % 5) for u in range(13) for i in (1, 2)] + [(u, 3, 4) for u in range(13)]
    got = {(a, b): s for a, b, n, s in rows(similarity.pearson_pairs(ratings(spark, data), 13))}
    assert got[1, 3] == 0.0 and got[1, 2] != 0.0
    assert {(a, b): s for a, b, n, s in rows(similarity.pearson_pairs(ratings(spark, data[:-1]), 14))}[1, 2] == 0.0


def test_cold_start_and_fallback(spark):
    train = ratings(spark, [(1, 1, 5), (1, 2, 3), (2, 1, 1)])
    test = spark.createDataFrame([(1, 9), (9, 1), (2, 2)], "user long, item long")
    assert rows(recommend.item_cf(train, test)) == [(1, 9, 0.0), (2, 2, 2.0), (9, 1, 0.0)]


def test_blend(spark):
    a = spark.createDataFrame([(1, 1, 4.0), (1, 2, 4.0)], "user long, item long, prediction double")
    b = spark.createDataFrame([(1, 1, 2.0)], "user long, item long, prediction double")
    assert rows(recommend.blend(a, b, 0.25)) == [(1, 1, 2.5)]


BARBELL = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_barbell(spark):
    g = edges(spark, BARBELL)
    got = {(a, b): v for a, b, v in rows(graph.edge_betweenness(g))}
    assert got[3, 4] == 9.0 and got[1, 2] == 1.0 and got[1, 3] == 4.0
    assert rows(graph.girvan_newman(g)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    whole = graph.modularity(g, g, graph.components(g)).first()[0]
    assert abs(whole) < 1e-12
    assert rows(graph.girvan_newman(g, held_edges=3)) == rows(graph.girvan_newman(g))
    assert rows(graph.edge_betweenness(g, held_edges=3)) == rows(graph.edge_betweenness(g))
    empty = g.limit(0)
    assert rows(graph.girvan_newman(empty)) == [] and rows(graph.edge_betweenness(empty)) == []


def test_isolated_edge_swaps_labels(spark):
    assert rows(graph.label_propagation(edges(spark, [(1, 2)]), 5)) == [(1, 2), (2, 1)]


def test_components_equal_search(spark):
    r = random.Random(4)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)]
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert rows(connected_components(edges(spark, pairs))) == sorted(label.items())
    assert rows(connected_components(edges(spark, pairs[:1]).limit(0))) == []


def test_co_graph(spark):
    pairs = spark.createDataFrame([(u, i) for u, s in ((1, "abc"), (2, "abd"), (3, "d")) for i in s], "user long, item string")
    assert rows(graph.co_graph(pairs, 2)) == [(1, 2, 2)]


def test_few_edges_are_met_where_few_nodes_are_left(monkeypatch):
    """A hub of 300 nodes that are joined among themselves, and one node beyond: the search must not meet all edges of the deepest level."""
    every = np.arange(1, 301)
    src = np.concatenate([np.zeros(300, int), np.repeat(every, 20), [300], np.arange(1000, 1010)])
    dst = np.concatenate([every, (np.repeat(every, 20) + np.tile(np.arange(1, 21), 300) - 1) % 300 + 1, [301], np.arange(1001, 1011)])
    held, met, steps = graph.Held(np.minimum(src, dst), np.maximum(src, dst)), [], graph.Held.steps
    held.labels = lambda found=held.labels(): found
    monkeypatch.setattr(graph.Held, "steps", lambda self, frontier: met.append(len((out := steps(self, frontier))[1])) or out)
    got = held.flows(np.array([0]))
    assert sum(met) < 400
    assert got[src == 300].max() == 1.0 and math.isclose(got[:300].sum(), 301) and not got[-10:].any()


def test_betweenness_sum_is_sum_of_distances(spark):
    r = random.Random(9)
    pairs = sorted({(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(24)) if a < b})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = 0
    for s in near:
        dist, queue = {s: 0}, [s]
        for u in queue:
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    queue.append(v)
        total += sum(dist.values())
    assert math.isclose(sum(x[2] for x in rows(graph.edge_betweenness(edges(spark, pairs)))), total / 2, abs_tol=1e-3)


def stream(spark, batches):
    return spark.createDataFrame([(b, i, k) for b, keys in enumerate(batches) for i, k in enumerate(keys)], "batch_id long, seq long, key long")


def test_bloom_first_batch_and_no_new_keys(spark):
    got = {r["batch_id"]: r for r in sketches.bloom_rates(stream(spark, [[1, 2], [1, 2], [3]])).collect()}
    assert got[0]["fpr"] == 0.0 and got[1]["fpr"] is None and 0 <= got[2]["fpr"] < 0.05
    every = {r["batch_id"]: r for r in sketches.bloom_rates(stream(spark, [[1, 2], [3], [1]]), cumulative=True).collect()}
    assert every[2]["fpr"] is None and every[1]["n_new"] == 1


def test_key_number_equals_big_integer(spark):
    texts = ["abc", "é", "", "a longer key 123"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "k string").select(sketches.key_number("k")).collect()]
    assert got == [int.from_bytes(t.encode(), "big") % sketches.BITS for t in texts]


def test_trailing_zeros(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1,), (8,), (12,)], "h long").select(sketches.trailing_zeros(F.col("h"))).collect()]
    assert got == [1, 0, 3, 2]


def test_fm_is_near_the_truth(spark):
    got = sketches.fm_estimates(stream(spark, [list(range(500)) * 2])).first()
    assert got["n_distinct"] == 500 and got["n_stream"] == 1000 and 125 <= got["estimate_std"] <= 2000


def test_reservoir_state():
    import pandas as pd

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    state, step = State(), jobs.reservoir_step(size=5)
    for begin in (0, 3, 50):
        out = list(step(("s",), iter([pd.DataFrame({"seq": range(begin, begin + 50), "key": range(begin, begin + 50)})]), state))[0]
    assert out["n"][0] == 150 and len(set(out["slots"][0])) == 5
    state = State()
    assert list(step(("s",), iter([pd.DataFrame({"seq": [1], "key": [7]})]), state))[0]["slots"][0] == [7]


def test_simulated_stream(spark):
    keys = readers.indexed(spark.createDataFrame([(x,) for x in "dcbaa"], "key string"), "key")
    assert rows(keys) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    got = readers.simulated_stream(keys, 3, 10)
    assert rows(got.groupBy("batch_id").count()) == [(0, 10), (1, 10), (2, 10)]


def test_watermark_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-05', 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = jobs.windowed_counts(jobs.read_stream(spark, str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").count() == 1


def test_clustering_guards(spark):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [9.0, 1.0])], "point_id long, features array<double>")
    centres = cluster.centroids(cluster.moments(points.where("point_id < 3").withColumn("c", F.lit(0)), "c"))
    got = {r["point_id"]: (r["cluster"], r["distance"]) for r in cluster.mahalanobis_assign(points, centres).collect()}
    assert got == {1: (0, 1.0), 2: (0, 1.0), 3: (None, 8.0)}


def test_bfr_places_every_point(spark):
    r = random.Random(1)
    points = spark.createDataFrame([(i, [r.gauss(10 * (i % 3), 1), r.gauss(-10 * (i % 3), 1)]) for i in range(240)], "point_id long, features array<double>")
    rounds, placed = cluster.bfr(points, 3, chunks=3)
    assert placed.count() == 240 == placed.select("point_id").distinct().count()
    last = rounds.orderBy(F.desc("round")).first()
    assert last["ds_points"] + last["cs_points"] + last["rs_points"] == 240


def test_bfr_of_nothing(spark):
    rounds, placed = cluster.bfr(spark.createDataFrame([], "point_id long, features array<double>"), 3)
    assert rows(rounds) == [] and rows(placed, "point_id", "cluster") == []


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],)], "items array<string>")
    assert [r["line"] for r in sinks.itemset_report(sets).collect()] == ["('a'),('b')", "('a', 'b')"]
    groups = spark.createDataFrame([([2, 1],), ([3],)], "members array<long>")
    assert [r["line"] for r in sinks.community_lines(groups).collect()] == ["'3'", "'1', '2'"]
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, betweenness double")
    assert [r["line"] for r in sinks.betweenness_lines(e).collect()] == ["('a', 'c'),2.5", "('a', 'b'),1.0"]
    sinks.write_itemset_report(sets, sets, str(tmp_path / "r"))
    assert "Frequent Itemsets:" in (next((tmp_path / "r").glob("part*"))).read_text()
    (tmp_path / "p.txt").write_text("1,0,2.5,3\n2,1,4,5\n")
    assert rows(readers.read_points(spark, str(tmp_path / "p.txt"))) == [(1, "0", [2.5, 3.0]), (2, "1", [4.0, 5.0])]
