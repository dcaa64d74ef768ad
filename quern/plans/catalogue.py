"""All registered queries of the engine and their SQL for DuckDB. Doubles are rounded to six digits in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import cluster, explore, graph, itemsets, recommend, similarity, sketches
from quern.plans import views
from quern.sources.readers import indexed, read_csv, read_json_lines, read_table
from quern.sources.sinks import as_json, itemset_report, write_csv, write_json
from quern.staging import Stages, fresh_path
from quern.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Negative zero becomes zero, as the two engines differ in it."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# Exploration


@query("SELECT count(*) FILTER (WHERE CAST(event_id AS VARCHAR) <> '') AS n_review, count(*) FILTER (WHERE contains(CAST(CAST(ts AS DATE) AS VARCHAR), '2024-01-1')) AS n_review_in_period, count(DISTINCT user_id) AS n_user, count(DISTINCT event_type) AS n_business FROM events")
def explore_summary(spark, d):
    events = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return explore.summary(events, "event_id", "day", "user_id", "event_type", "2024-01-1")


@query("SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_user(spark, d):
    return explore.top(read_table(spark, d, "events"), "user_id")


@query("SELECT l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top10_item(spark, d):
    return explore.top(read_table(spark, d, "lineitem"), "l_partkey")


@query('SELECT r.p AS "partition", coalesce(n, 0) AS n_items FROM (SELECT unnest(range(120)) AS p) r LEFT JOIN (SELECT (o_custkey % 100) % 120 AS p, count(*) AS n FROM orders GROUP BY 1) u ON r.p = u.p')
def partition_stats(spark, d):
    return explore.partition_stats(read_table(spark, d, "orders"), "o_custkey", 120)


@query()
def partition_physical(spark, d):
    return explore.physical_partitions(read_table(spark, d, "orders"), 8, "o_custkey")


@query("SELECT n_name, round(avg(l_quantity), 6) AS average FROM lineitem JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON l_suppkey = s_suppkey GROUP BY 1")
def region_avg(spark, d):
    nation = read_table(spark, d, "nation")
    places = read_table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return rounded(explore.grouped_average(read_table(spark, d, "lineitem"), places, "l_suppkey", "n_name", "l_quantity"), "average")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_outer_unmatched(spark, d):
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return explore.outer_lookup(read_table(spark, d, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
def left_outer_matched(spark, d):
    return left_outer_unmatched(spark, d).where("o_orderkey IS NOT NULL")


@query("SELECT user_id, round(avg(value + length(event_type)), 6) AS feedback_mean FROM events GROUP BY 1")
def user_feedback_mean(spark, d):
    events = read_table(spark, d, "events").withColumn("n", F.length("event_type"))
    return rounded(explore.feedback_mean(events, "user_id", "value", "n"), "feedback_mean")


def _keys(spark, d):
    return read_table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")), read_table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def distinct_union(spark, d):
    return explore.set_operation(*_keys(spark, d), "union")


@query("SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def set_intersect(spark, d):
    return explore.set_operation(*_keys(spark, d), "intersect")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except(spark, d):
    return explore.set_operation(read_table(spark, d, "customer").select(F.col("c_custkey").alias("k")), read_table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "except")


@query("""SELECT '{"n_name":"' || n_name || '","n":' || CAST(count(*) AS VARCHAR) || '}' AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def json_rows(spark, d):
    joined = read_table(spark, d, "customer").join(F.broadcast(read_table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return as_json(joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n")))


_CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def json_lines_source(spark, d):
    path = fresh_path(spark, "json")
    write_json(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, one_file=False)
    return read_json_lines(spark, path, _CUSTOMERS)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_source(spark, d):
    path = fresh_path(spark, "csv")
    write_csv(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, one_file=False)
    return read_csv(spark, path, _CUSTOMERS)


@query("SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS position FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def dense_index(spark, d):
    return indexed(read_table(spark, d, "lineitem"), "l_partkey")


# Itemsets


@query(f"WITH {views.EVENT_PAIRS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n FROM pairs GROUP BY 1")
def basket_build(spark, d):
    pairs = itemsets.baskets(views.event_pairs(spark, d), "basket", "item")
    return pairs.groupBy("basket").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.EVENT_PAIRS} SELECT basket, item FROM pairs WHERE basket IN (SELECT basket FROM pairs GROUP BY 1 HAVING count(*) > 3)")
def basket_filtered(spark, d):
    return itemsets.baskets(views.event_pairs(spark, d), "basket", "item", larger_than=3)


@query("SELECT regexp_replace(strftime(o_orderdate, '%-m/%-d/%Y'), '([0-9]{2})([0-9]{2})$', '\\2') || '-' || CAST(o_custkey AS VARCHAR) AS basket, CAST(l_partkey AS VARCHAR) AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def retail_baskets(spark, d):
    rows = read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    shown = rows.select(F.date_format(F.col("o_orderdate").cast("timestamp"), "M/d/yyyy").alias("date"), F.col("o_custkey").cast("string").alias("customer"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("product"))
    return itemsets.retail_pairs(shown, "date", "customer", "product")


def _support(pairs: DataFrame, share: float) -> int:
    return int(pairs.select("basket").distinct().count() * share)


def _frequent(size: int, share: float) -> str:
    joins = "".join(f" JOIN pairs p{k} ON p{k}.basket = p1.basket AND p{k}.item > p{k - 1}.item" for k in range(2, size + 1))
    items = " || ',' || ".join(f"p{k}.item" for k in range(1, size + 1))
    return f"SELECT CAST({size} AS BIGINT) AS size, {items} AS items, count(*) AS n FROM pairs p1{joins} GROUP BY 1, 2 HAVING count(*) >= (SELECT CAST(floor(count(DISTINCT basket) * {share!r}) AS BIGINT) FROM pairs)"


def _brands(spark, d, size, share):
    pairs = Stages(spark, "brands").write(views.brand_pairs(spark, d))
    return itemsets.shown(itemsets.frequent_itemsets(pairs, _support(pairs, share), size)).where(F.col("size") == size)


@query(f"WITH {views.BRANDS} {_frequent(1, 0.1)}")
def frequent_items_1(spark, d):
    return _brands(spark, d, 1, 0.1)


@query(f"WITH {views.BRANDS} {_frequent(2, 0.022)}")
def frequent_items_2(spark, d):
    return _brands(spark, d, 2, 0.022)


@query(f"WITH {views.BRANDS} {_frequent(3, 0.0032)}")
def frequent_items_3(spark, d):
    return _brands(spark, d, 3, 0.0032)


_ALL_EVENTS = f"WITH {views.EVENT_PAIRS} " + " UNION ALL ".join(_frequent(k, 0.05) for k in range(1, 6))


@query(_ALL_EVENTS)
def frequent_itemsets_all(spark, d):
    pairs = Stages(spark, "events").write(views.event_pairs(spark, d))
    return itemsets.shown(itemsets.frequent_itemsets(pairs, _support(pairs, 0.05)))


@query(_ALL_EVENTS)
def itemset_fpgrowth(spark, d):
    pairs = Stages(spark, "events").write(views.event_pairs(spark, d))
    return itemsets.shown(itemsets.fp_growth(pairs, _support(pairs, 0.05)))


@query(_ALL_EVENTS)
def itemset_son(spark, d):
    pairs = Stages(spark, "events").write(views.event_pairs(spark, d))
    return itemsets.shown(itemsets.son_itemsets(pairs, _support(pairs, 0.05), parts=4))


@query(f"WITH each AS ({_ALL_EVENTS}) SELECT CAST(size AS INTEGER) AS size, string_agg('(' || chr(39) || replace(items, ',', chr(39) || ', ' || chr(39)) || chr(39) || ')', ',' ORDER BY items) AS line FROM each GROUP BY 1")
def itemset_lines(spark, d):
    pairs = Stages(spark, "events").write(views.event_pairs(spark, d))
    return itemset_report(itemsets.frequent_itemsets(pairs, _support(pairs, 0.05)))


_RETAIL = f"rows AS ({ORACLE_SQL['retail_baskets']}), d AS (SELECT DISTINCT basket, item FROM rows), pairs AS (SELECT * FROM d WHERE basket IN (SELECT basket FROM d GROUP BY 1 HAVING count(*) > 2))"


@query(f"WITH {_RETAIL} {_frequent(1, 0.002)} UNION ALL {_frequent(2, 0.002)}")
def retail_itemsets(spark, d):
    pairs = Stages(spark, "retail").write(itemsets.baskets(retail_baskets(spark, d), "basket", "item", larger_than=2))
    return itemsets.shown(itemsets.frequent_itemsets(pairs, _support(pairs, 0.002), 2))


# Similarity

_JACCARD = f"""WITH {views.WORDS}, sets AS (SELECT id, string_agg(item, ' ' ORDER BY item) AS whole FROM words GROUP BY 1),
reps AS (SELECT id, min(id) OVER (PARTITION BY whole) AS rep FROM sets), own AS (SELECT w.id, w.item FROM words w JOIN reps r ON r.id = w.id AND r.rep = w.id),
n AS (SELECT id, count(*) AS n FROM own GROUP BY 1),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM own a JOIN own b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.5 UNION ALL SELECT rep, id, 1.0 FROM reps WHERE rep <> id"""


@query(_JACCARD)
def jaccard_exact_pairs(spark, d):
    return rounded(similarity.jaccard_pairs(views.document_sets(spark, d), 0.5), "similarity")


@query(_JACCARD)
def jaccard_lsh_pairs(spark, d):
    return rounded(similarity.lsh_pairs(views.document_sets(spark, d), 0.5), "similarity")


_HASHES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(similarity.coefficients(20)))


@query(f"SELECT id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS signature FROM (SELECT o_custkey AS id, i, min((a * l_partkey + b) % {similarity.PRIME}) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES {_HASHES}) h(i, a, b) GROUP BY 1, 2) GROUP BY 1")
def minhash_signatures(spark, d):
    sets = views.part_pairs(spark, d).select(F.col("user").alias("id"), F.col("item").alias("x"))
    return similarity.minhash_signatures(sets, 20).select("id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def _pearson(source: str, min_corated: int) -> str:
    return f"""moments AS (SELECT a.item AS a, b.item AS b, count(*) AS n, sum(a.stars) AS sx, sum(b.stars) AS sy, sum(a.stars * b.stars) AS sxy, sum(a.stars * a.stars) AS sxx, sum(b.stars * b.stars) AS syy FROM {source} a JOIN {source} b ON a."user" = b."user" AND a.item < b.item GROUP BY 1, 2),
sims AS (SELECT a, b, n, CASE WHEN n >= {min_corated} AND s > 1e-9 THEN (sxy - sx * sy / n) / s ELSE 0.0 END AS similarity FROM (SELECT *, sqrt(greatest(sxx - sx * sx / n, 0)) * sqrt(greatest(syy - sy * sy / n, 0)) AS s FROM moments))"""


@query(f"WITH {views.RATINGS}, {_pearson('ratings', 1)} SELECT a, b, n, round(similarity, 6) + 0.0 AS similarity FROM sims")
def pearson_item_pairs(spark, d):
    return rounded(similarity.pearson_pairs(views.ratings(spark, d), 1), "similarity")


@query(f"WITH {views.RATINGS}, {_pearson('ratings', 150)} SELECT a, b, n, round(similarity, 6) + 0.0 AS similarity FROM sims")
def pearson_item_pairs_gated(spark, d):
    return rounded(similarity.pearson_pairs(views.ratings(spark, d), 150), "similarity")


# Recommendation


def _neighbours(min_corated: int, condition: str = "") -> str:
    return f"""WITH {views.RATINGS}, {_pearson('train', min_corated)},
sym AS (SELECT a AS item, b AS neighbour, similarity FROM sims UNION ALL SELECT b, a, similarity FROM sims),
scored AS (SELECT t."user", t.item, r.item AS neighbour, round(CASE WHEN t.item = r.item THEN 1.0 ELSE coalesce(b.similarity, 0.0) END, 9) AS similarity, r.stars FROM (SELECT DISTINCT "user", item FROM test) t JOIN train r ON r."user" = t."user" LEFT JOIN sym b ON b.item = t.item AND b.neighbour = r.item),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY similarity DESC, neighbour) AS rank, count(*) OVER (PARTITION BY "user", item) AS n FROM scored {condition})"""


_PREDICT = """, sums AS (SELECT "user", item, sum(similarity * stars) AS num, sum(abs(similarity)) AS den FROM chosen GROUP BY 1, 2)
SELECT t."user", t.item, round(CASE WHEN u.m IS NULL OR i.m IS NULL THEN 0.0 WHEN abs(num) > 1e-9 AND den > 1e-9 THEN num / den ELSE (u.m + i.m) / 2 END, 6) + 0.0 AS prediction
FROM (SELECT DISTINCT "user", item FROM test) t LEFT JOIN (SELECT "user", avg(stars) AS m FROM train GROUP BY 1) u ON u."user" = t."user" LEFT JOIN (SELECT item, avg(stars) AS m FROM train GROUP BY 1) i ON i.item = t.item LEFT JOIN sums s ON s."user" = t."user" AND s.item = t.item"""


@query(_neighbours(13) + ' SELECT "user", item, neighbour, round(similarity, 6) + 0.0 AS similarity, round(stars, 6) AS stars FROM ranked WHERE rank <= 15')
def itemcf_topn(spark, d):
    train, test, _ = views.split_ratings(spark, d)
    return rounded(recommend.neighbours(train, test), "similarity", "stars")


@query(_neighbours(13) + ", chosen AS (SELECT * FROM ranked WHERE rank <= 15)" + _PREDICT)
def itemcf_predict(spark, d):
    train, test, _ = views.split_ratings(spark, d)
    return rounded(recommend.item_cf(train, test), "prediction")


@query(_neighbours(1_000_000).replace("THEN 1.0 ELSE", "THEN 0.0 ELSE") + ", chosen AS (SELECT * FROM ranked WHERE rank <= 15)" + _PREDICT)
def itemcf_fallback(spark, d):
    train, test, _ = views.split_ratings(spark, d)
    return rounded(recommend.item_cf(train, test, min_corated=1_000_000, exclude_self=True), "prediction")


@query(_neighbours(1, "WHERE similarity >= 0") + ", chosen AS (SELECT * FROM ranked WHERE rank <= 30 UNION ALL SELECT * FROM ranked WHERE rank = n)" + _PREDICT)
def hybrid_cf_predict(spark, d):
    train, test, _ = views.split_ratings(spark, d)
    return rounded(recommend.hybrid_cf(train, test), "prediction")


@query(f"""WITH {views.RATINGS}, cf AS ({ORACLE_SQL['hybrid_cf_predict']}), means AS (SELECT item, avg(stars) AS prediction FROM train GROUP BY 1)
SELECT "user", item, round(0.00001 * cf.prediction + (1 - 0.00001) * means.prediction, 6) AS prediction FROM cf JOIN means USING (item)""")
def blend_predict(spark, d):
    """The hybrid's blend with means of items in place of trees."""
    train, test, _ = views.split_ratings(spark, d)
    means = test.select("user", "item").join(train.groupBy("item").agg(F.avg("stars").alias("prediction")), "item")
    return rounded(recommend.blend(hybrid_cf_predict(spark, d), means), "prediction")


@query(f"""WITH {views.RATINGS}, cf AS ({ORACLE_SQL['itemcf_predict']}) SELECT round(sqrt(avg(pow(prediction - stars, 2))), 6) AS rmse, count(*) AS n FROM cf JOIN ratings USING ("user", item)""")
def itemcf_rmse(spark, d):
    return rounded(recommend.rmse(itemcf_predict(spark, d), views.split_ratings(spark, d)[2]), "rmse")


def _features(spark, d, pairs, feedback=False):
    items = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("item_stars"), F.col("s_nationkey").cast("double").alias("item_count"))
    orders = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.avg("o_totalprice").alias("user_stars"), F.count(F.lit(1)).cast("double").alias("user_count"))
    means = explore.feedback_mean(read_table(spark, d, "events"), "user_id", "value").withColumnRenamed("user_id", "user") if feedback else None
    return recommend.rating_features(pairs, items, orders, means)


@query(f'WITH {views.RATINGS} SELECT r."user", r.item, round(stars, 6) AS stars, s_acctbal AS item_stars, CAST(s_nationkey AS DOUBLE) AS item_count, round(o.p, 6) AS user_stars, o.n AS user_count FROM train r JOIN supplier ON s_suppkey = r.item JOIN (SELECT o_custkey, avg(o_totalprice) AS p, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) o ON o_custkey = r."user"')
def rating_features(spark, d):
    train, _, _ = views.split_ratings(spark, d)
    return rounded(_features(spark, d, train), "stars", "user_stars")


_INPUTS = ["item_stars", "item_count", "user_stars", "user_count"]


def _boosted(spark, d, feedback=False, rounds=20, **params):
    train, test, _ = views.split_ratings(spark, d)
    inputs = [*_INPUTS, "feedback_mean"] if feedback else _INPUTS
    stages = Stages(spark, "trees")
    model = recommend.fit_boosted_trees(stages.write(_features(spark, d, train, feedback)), inputs, rounds=rounds, depth=4, **params)
    return train, test, recommend.predict(model, _features(spark, d, test, feedback))


@query()
def gbt_predict(spark, d):
    return _boosted(spark, d)[2]


@query()
def hybrid_predict(spark, d):
    train, test, trees = _boosted(spark, d)
    return recommend.blend(recommend.hybrid_cf(train, test), trees)


@query()
def competition_predict(spark, d):
    return _boosted(spark, d, feedback=True, rate=0.09, subsample=0.85, column_share=0.85)[2]


# Graphs


@query(f"WITH {views.GRAPH} SELECT src, dst, common FROM edges")
def cograph_edges(spark, d):
    return views.graph(spark, d)


@query(f"WITH {views.GRAPH} SELECT src AS node, count(*) AS degree FROM two GROUP BY 1")
def graph_degree(spark, d):
    return graph.degrees(views.graph(spark, d))


def _edges(spark, d):
    return Stages(spark, "graph").write(views.graph(spark, d))


#: Rounds and levels that the SQL unrolls; the graphs of the test tables are less deep.
_DEPTH = 10


def _components() -> str:
    """Smallest labels, passed on to neighbours."""
    rounds = ", ".join(f"m{k} AS MATERIALIZED (SELECT t.src AS node, least(min(o.label), min(n.label)) AS label FROM two t JOIN m{k - 1} o ON o.node = t.src JOIN m{k - 1} n ON n.node = t.dst GROUP BY 1)" for k in range(1, _DEPTH + 1))
    return f"WITH {views.GRAPH}, m0 AS (SELECT node, node AS label FROM nodes), {rounds}, parts AS (SELECT node, label AS component FROM m{_DEPTH})"


_COMPONENTS = _components()


@query(_COMPONENTS + " SELECT node, component FROM parts")
def components(spark, d):
    return graph.components(_edges(spark, d))


def _lpa() -> str:
    rounds = ", ".join(
        f"l{k} AS (SELECT node, label FROM (SELECT t.dst AS node, l.label, row_number() OVER (PARTITION BY t.dst ORDER BY count(*) DESC, l.label) AS r FROM two t JOIN l{k - 1} l ON t.src = l.node GROUP BY t.dst, l.label) WHERE r = 1)" for k in range(1, 6)
    )
    return f"WITH {views.GRAPH}, l0 AS (SELECT node, node AS label FROM nodes), {rounds}"


@query(_lpa() + " SELECT node, label FROM l5")
def label_propagation(spark, d):
    return graph.label_propagation(_edges(spark, d))


@query(_lpa() + " SELECT string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members, count(*) AS size FROM l5 GROUP BY label")
def label_communities(spark, d):
    found = graph.communities(graph.label_propagation(_edges(spark, d)))
    return found.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.size("members").cast("long").alias("size"))


def _betweenness() -> str:
    """Numbers of paths level by level, then credits from the deepest level upwards."""
    levels = ["f0 AS MATERIALIZED (SELECT node AS root, node, 1.0::DOUBLE AS sigma FROM nodes)", "s0 AS MATERIALIZED (SELECT root, node FROM f0)"]
    for k in range(1, _DEPTH + 1):
        levels.append(f"f{k} AS MATERIALIZED (SELECT f.root, t.dst AS node, sum(f.sigma) AS sigma FROM f{k - 1} f JOIN two t ON t.src = f.node ANTI JOIN s{k - 1} s ON s.root = f.root AND s.node = t.dst WHERE f.root IN (SELECT root FROM s{k - 1} GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM nodes)) GROUP BY 1, 2)")
        levels.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT root, node FROM f{k})")
    levels.append(f"c{_DEPTH} AS MATERIALIZED (SELECT root, node, sigma, 1.0::DOUBLE AS credit FROM f{_DEPTH})")
    for k in range(_DEPTH, 0, -1):
        levels.append(f"e{k} AS MATERIALIZED (SELECT p.root, p.node AS parent, c.node AS child, c.credit * p.sigma / c.sigma AS flow FROM f{k - 1} p JOIN two t ON t.src = p.node JOIN c{k} c ON c.root = p.root AND c.node = t.dst)")
        levels.append(f"c{k - 1} AS MATERIALIZED (SELECT f.root, f.node, f.sigma, 1 + coalesce(g.gain, 0) AS credit FROM f{k - 1} f LEFT JOIN (SELECT root, parent, sum(flow) AS gain FROM e{k} GROUP BY 1, 2) g ON g.root = f.root AND g.parent = f.node)")
    flows = " UNION ALL ".join(f"SELECT least(parent, child) AS src, greatest(parent, child) AS dst, sum(flow) AS flow FROM e{k} GROUP BY 1, 2" for k in range(1, _DEPTH + 1))
    return f"WITH {views.GRAPH}, {', '.join(levels)} SELECT src, dst, round(sum(flow) / 2, 5) AS betweenness FROM ({flows}) GROUP BY 1, 2"


@query(_betweenness())
def edge_betweenness(spark, d):
    return graph.edge_betweenness(_edges(spark, d))


@query(_COMPONENTS + ", deg AS (SELECT src AS node, count(*) AS k FROM two GROUP BY 1), m AS (SELECT CAST(sum(k) AS DOUBLE) AS m2 FROM deg), a AS (SELECT p.component AS c, count(*) AS a FROM two JOIN parts p ON p.node = src JOIN parts q ON q.node = dst AND p.component = q.component GROUP BY 1), k AS (SELECT component AS c, CAST(sum(k) AS DOUBLE) AS k FROM parts JOIN deg USING (node) GROUP BY 1) SELECT round(sum(coalesce(a, 0) / m2 - (k / m2) * (k / m2)), 6) AS modularity FROM k LEFT JOIN a USING (c), m")
def modularity_components(spark, d):
    edges = _edges(spark, d)
    return rounded(graph.modularity(edges, edges, graph.components(edges)), "modularity")


@query()
def girvan_newman(spark, d):
    return graph.girvan_newman(Stages(spark, "graph").write(views.brand_graph(spark, d)))


# Stream sketches

_HASHED = "(((7919 * fn + 104729) % 9999 + 1) * (key % {m}) + (6007 * fn + 15013) % 9999) % {m}"
_B = _HASHED.format(m=sketches.BITS)
_BLOOM = f"""WITH {views.STREAM}, keys AS (SELECT batch_id, key, count(*) AS n FROM stream GROUP BY 1, 2),
probes AS (SELECT batch_id, key, n, {_B} AS h FROM keys, (SELECT unnest(range({sketches.BIT_HASHES})) AS fn)),
bits AS (SELECT DISTINCT batch_id + 1 AS batch_id, h FROM probes),
tested AS (SELECT p.batch_id, p.key, max(p.n) AS n, count(b.h) AS hit FROM probes p LEFT JOIN bits b ON b.batch_id = p.batch_id AND b.h = p.h WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.batch_id = p.batch_id - 1 AND k.key = p.key) GROUP BY 1, 2),
rates AS (SELECT batch_id, sum(n) AS n_new, sum(n * hit) AS hits, sum(CASE WHEN hit = {sketches.BIT_HASHES} THEN n ELSE 0 END) AS fe FROM tested GROUP BY 1)"""


@query(_BLOOM + f" SELECT batch_id, CAST(coalesce(n_new, 0) AS BIGINT) AS n_new, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(hits / (n_new * {sketches.BIT_HASHES}), 6) AS fpr FROM (SELECT DISTINCT batch_id FROM stream) LEFT JOIN rates USING (batch_id)")
def bloom_fpr(spark, d):
    return rounded(sketches.bloom_rates(views.stream(spark, d)), "fpr").select("batch_id", "n_new", "hits", "fpr")


@query(_BLOOM + " SELECT batch_id, CAST(coalesce(fe, 0) AS BIGINT) AS false_elements, round(fe / n_new, 6) AS element_fpr FROM (SELECT DISTINCT batch_id FROM stream) LEFT JOIN rates USING (batch_id)")
def bloom_fpr_element(spark, d):
    return rounded(sketches.bloom_rates(views.stream(spark, d)), "element_fpr").select("batch_id", "false_elements", "element_fpr")


_F = _HASHED.format(m=sketches.FM_PRIME)
_FM = f"""WITH {views.STREAM}, keys AS (SELECT batch_id, key, count(*) AS n FROM stream GROUP BY 1, 2),
tails AS (SELECT batch_id, fn, max(CASE WHEN h = 0 THEN 1 ELSE bit_count((h & (-h)) - 1) END) AS r FROM (SELECT batch_id, fn, {_F} AS h FROM keys, (SELECT unnest(range({sketches.FM_HASHES})) AS fn)) GROUP BY 1, 2),
powers AS (SELECT batch_id, list_sort(list(pow(2.0, r))) AS p FROM tails GROUP BY 1),
sizes AS (SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_stream, count(*) AS n_distinct FROM keys GROUP BY 1)"""


@query(_FM + " SELECT batch_id, n_stream, n_distinct, CAST(floor((p[51] + p[52]) / 2) AS BIGINT) AS estimate FROM sizes JOIN powers USING (batch_id)")
def fm_estimate(spark, d):
    return sketches.fm_estimates(views.stream(spark, d)).drop("estimate_std")


@query(_FM + " SELECT batch_id, n_stream, n_distinct, CAST(floor((p[50] + p[51]) / 2) AS BIGINT) AS estimate_std FROM sizes JOIN powers USING (batch_id)")
def fm_estimate_std(spark, d):
    return sketches.fm_estimates(views.stream(spark, d)).drop("estimate")


@query(f"WITH {views.STREAM} SELECT batch_id, count(DISTINCT key) AS n FROM stream GROUP BY 1")
def distinct_exact(spark, d):
    return views.stream(spark, d).groupBy("batch_id").agg(F.count_distinct("key").alias("n"))


@query()
def distinct_approx(spark, d):
    return sketches.distinct_sketch(views.stream(spark, d), "batch_id", "key")


@query(f"WITH {views.STREAM} SELECT batch_id, seq, key, (seq * 2654435761 + 12345) % 4294967291 AS priority FROM stream ORDER BY priority, seq LIMIT 100")
def reservoir_bottomk(spark, d):
    return sketches.bottom_k(views.stream(spark, d), "seq", 100)


@query()
def reservoir_stateful(spark, d):
    return jobs.reservoir_over_events(spark, d)


@query(_BLOOM + f" SELECT batch_id, CAST(coalesce(n_new, 0) AS BIGINT) AS n_new, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(hits / (n_new * {sketches.BIT_HASHES}), 6) AS fpr FROM (SELECT DISTINCT batch_id FROM stream) LEFT JOIN rates USING (batch_id)")
def streaming_bloom(spark, d):
    return rounded(jobs.bloom_over_events(spark, d), "fpr").select("batch_id", "n_new", "hits", "fpr")


@query(_FM + " SELECT batch_id, n_stream, n_distinct, CAST(floor((p[51] + p[52]) / 2) AS BIGINT) AS estimate FROM sizes JOIN powers USING (batch_id)")
def streaming_fm(spark, d):
    return jobs.fm_over_events(spark, d).drop("estimate_std")


# Clustering

_MOMENTS = "each AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), moments AS (SELECT label AS cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM each GROUP BY 1, 2), centres AS (SELECT cluster, dim, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS std FROM moments)"


@query(f'WITH {_MOMENTS} SELECT cluster, CAST(dim AS INTEGER) AS dim, n, round(s, 6) + 0.0 AS "sum", round(q, 6) AS sumsq FROM moments')
def cluster_moments(spark, d):
    return rounded(cluster.moments(views.points(spark, d), "label"), "sum", "sumsq")


@query(f"WITH {_MOMENTS} SELECT cluster, CAST(dim AS INTEGER) AS dim, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM centres")
def cluster_centroid_std(spark, d):
    return rounded(cluster.centroids(cluster.moments(views.points(spark, d), "label")), "mean", "std")


@query(f"WITH {_MOMENTS}, near AS (SELECT vec_id, c.cluster, sqrt(sum(CASE WHEN std > 0 THEN ((x - mean) / std) * ((x - mean) / std) ELSE 0 END)) AS distance, count(*) AS d FROM each e JOIN centres c ON c.dim = e.dim GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS r FROM near) SELECT vec_id AS point_id, CASE WHEN distance < 1.05 * sqrt(d) THEN cluster END AS cluster, round(distance, 6) AS distance FROM best WHERE r = 1")
def mahalanobis_assign(spark, d):
    points = views.points(spark, d)
    return rounded(cluster.mahalanobis_assign(points, cluster.centroids(cluster.moments(points, "label")), gate=1.05), "distance")


@query()
def bfr_rounds(spark, d):
    return cluster.bfr(views.points(spark, d), 10)[0]


@query()
def bfr_assign(spark, d):
    return cluster.bfr(views.points(spark, d), 10)[1]
