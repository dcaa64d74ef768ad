"""Co-occurrence graphs and communities. Edges are canonical: src < dst, once each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.staging import Stages


#: Edges up to which a worker holds a whole graph (some 60 bytes each); larger ones are searched by joins.
HELD_EDGES = 5_000_000


def co_graph(pairs: DataFrame, threshold: int) -> DataFrame:
    """src < dst, common: users that share ``threshold`` items or more. ``pairs``: user, item, distinct.

    Users with fewer items than the threshold can't have an edge and are left out before the join.
    """
    enough = pairs.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    kept = pairs.join(enough, "user", "left_semi")
    x, y = kept.select(F.col("user").alias("src"), "item"), kept.select(F.col("user").alias("dst"), "item")
    return x.join(y, "item").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    """node: the endpoints."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node)."""
    return connected_components(edges)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label after synchronous rounds; each takes its neighbours' most frequent label, ties the smallest.

    Votes are counted before the join decides, so a hub's neighbours are pre-aggregated.
    """
    stages = Stages(edges.sparkSession, "labels")
    two = stages.write(both_ways(edges))
    labels = vertices(edges).select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        votes = two.join(labels, two["src"] == labels["node"]).groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("less"), "label")).alias("b"))
        labels = stages.write(best.select("node", F.col("b.label").alias("label")))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """members (sorted arrays) by size, then members."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members").orderBy(F.size("members"), "members")


def _level_counts(two: DataFrame, nodes: DataFrame, stages: Stages) -> DataFrame:
    """root, node, dist, sigma: distances and numbers of shortest paths, a frontier of all roots at a time; levels are appended."""
    frontier = stages.write(nodes.select(F.col("node").alias("root"), "node", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    before = seen = frontier
    dist = 0
    while True:
        step = frontier.join(two, frontier["node"] == two["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        dist += 1
        # A neighbour of this level lies in it, in the one before, or in the next.
        near = frontier.select("root", "node").unionByName(before.select("root", "node"))
        fresh = stages.write(step.join(near, ["root", "node"], "left_anti").select("root", "node", F.lit(dist).alias("dist"), "sigma"))
        if fresh.limit(1).count() == 0:
            return seen
        seen, before, frontier = seen.unionByName(fresh), frontier, fresh


def edge_betweenness(edges: DataFrame, digits: int = 5, held_edges: int = HELD_EDGES) -> DataFrame:
    """src < dst, betweenness: shortest paths through each edge, each unordered pair of ends once.

    A graph of at most ``held_edges`` edges goes to the workers, which share out the roots; a larger one is searched
    by level-synchronous joins forward (numbers of paths) and backward (credits), for all roots together.
    """
    plain = Stages(edges.sparkSession, "betweenness").write(edges.select("src", "dst"))
    if plain.limit(held_edges + 1).count() <= held_edges:
        return _shared_out(plain).select("src", "dst", F.round("betweenness", digits).alias("betweenness"))
    return _betweenness_by_joins(plain, digits)


def _add(sums: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """Add values to sums at places that may repeat; many of them in one pass over all sums."""
    if 4 * len(places) < len(sums):
        np.add.at(sums, places, values)
    else:
        sums += np.bincount(places, values, len(sums))


class Held:
    """A graph in arrays: nodes, and per node its neighbours with the numbers of the edges."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, nodes: np.ndarray | None = None):
        self.nodes = np.unique(np.concatenate([src, dst])) if nodes is None else nodes
        self.a, self.b = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        tail, head = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
        order = np.argsort(tail, kind="stable")
        self.head, self.edge = head[order], order % max(len(src), 1)
        self.first = np.searchsorted(tail[order], np.arange(len(self.nodes) + 1))

    def steps(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tails, places) of all edges that leave ``frontier``."""
        n = self.first[frontier + 1] - self.first[frontier]
        places = np.arange(n.sum()) + np.repeat(self.first[frontier] - np.cumsum(n) + n, n)
        return np.repeat(frontier, n), places

    def flows(self, roots: np.ndarray) -> np.ndarray:
        """Per edge the credits of the shortest paths from ``roots``, summed; each component is searched in arrays of its own size."""
        total, label = np.zeros(len(self.a)), self.labels()
        nodes, edges = np.argsort(label, kind="stable"), np.argsort(label[self.a], kind="stable")
        roots = roots[np.argsort(label[roots], kind="stable")]
        parts = np.unique(label[roots])
        cuts = [np.searchsorted(of, [parts, parts + 1]).T for of in (label[nodes], label[self.a][edges], label[roots])]
        for n, e, r in zip(*cuts, strict=True):
            own, mine = nodes[n[0] : n[1]], edges[e[0] : e[1]]
            total[mine] = Held(self.a[mine], self.b[mine], own)._connected_flows(np.searchsorted(own, roots[r[0] : r[1]]))
        return total

    def _connected_flows(self, roots: np.ndarray) -> np.ndarray:
        """``flows`` of a connected graph."""
        n, total = len(self.nodes), np.zeros(len(self.a))
        for root in roots:
            dist, sigma, credit = np.full(n, -1, np.int32), np.zeros(n), np.ones(n)
            dist[root], sigma[root] = 0, 1.0
            frontier, levels, seen = np.array([root]), [], 1
            while seen < n:  # from the side with fewer nodes: those found last, or those not found yet
                if n - seen < len(frontier):
                    heads, places = self.steps((dist < 0).nonzero()[0])
                    tails = self.head[places]
                    down = (dist[tails] == len(levels)).nonzero()[0]
                else:
                    tails, places = self.steps(frontier)
                    heads = self.head[places]
                    down = (dist[heads] < 0).nonzero()[0]
                tails, heads, places = tails[down], heads[down], places[down]
                _add(sigma, heads, sigma[tails])
                dist[heads] = len(levels) + 1
                levels.append((tails, heads, self.edge[places]))
                frontier = np.unique(heads) if 4 * len(heads) < n else (dist == len(levels)).nonzero()[0]
                seen += len(frontier)
            for tails, heads, edge in reversed(levels):
                flow = credit[heads] * sigma[tails] / sigma[heads]
                _add(credit, tails, flow)
                total[edge] += flow  # a root meets each edge once
        return total

    def labels(self) -> np.ndarray:
        """Per node the smallest node of its component, by place."""
        label = np.full(len(self.nodes), -1)
        for n in range(len(label)):
            if label[n] < 0:
                frontier = np.array([n])
                while len(frontier):
                    label[frontier] = n
                    heads = self.head[self.steps(frontier)[1]]
                    frontier = np.unique(heads[label[heads] < 0])
        return label


def _held(edges: DataFrame) -> Held:
    """A graph whose number of edges was checked."""
    rows = edges.select("src", "dst").toPandas()
    return Held(rows["src"].to_numpy(), rows["dst"].to_numpy())


def _flows(spark, graph: Held) -> DataFrame:
    """edge (its number), betweenness; the roots are dealt over the cluster."""
    sent = spark.sparkContext.broadcast(graph)
    parts = max(1, min(len(graph.nodes), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        total = g.flows(np.concatenate([np.empty(0, np.int64), *(b.column("id").to_numpy() for b in batches)]).astype(np.int64))
        for at in range(0, len(total), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))[cut]), pa.array(total[cut])], names=["edge", "flow"])

    return spark.range(0, len(graph.nodes), 1, parts).mapInArrow(run, "edge long, flow double").groupBy("edge").agg((F.sum("flow") / 2).alias("betweenness"))


def _shared_out(edges: DataFrame) -> DataFrame:
    """src, dst, betweenness of a graph whose number of edges was checked."""
    spark = edges.sparkSession
    graph = _held(edges)
    if not len(graph.a):
        return edges.withColumn("betweenness", F.lit(0.0))
    sent = spark.sparkContext.broadcast(graph)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for b in batches:
            e = b.column("edge").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(g.nodes[g.a[e]]), pa.array(g.nodes[g.b[e]]), b.column("betweenness")], names=["src", "dst", "betweenness"])

    kind = edges.schema["src"].dataType.simpleString()
    return _flows(spark, graph).mapInArrow(named, f"src {kind}, dst {kind}, betweenness double")


def _betweenness_by_joins(edges: DataFrame, digits: int) -> DataFrame:
    stages = Stages(edges.sparkSession, "betweenness")
    plain = stages.write(edges.select("src", "dst"))
    two = stages.write(both_ways(plain))
    seen = stages.write(_level_counts(two, vertices(plain), stages))
    child = seen.select("root", F.col("node").alias("child"), F.col("dist").alias("cd"), F.col("sigma").alias("cs"))
    dag = stages.write(
        seen.join(two, seen["node"] == two["src"]).select("root", F.col("node").alias("parent"), F.col("dist").alias("pd"), F.col("sigma").alias("ps"), F.col("dst").alias("child")).join(child, ["root", "child"]).where("cd = pd + 1").select("root", "parent", "child", "cd", (F.col("ps") / F.col("cs")).alias("share"))
    )
    deepest = dag.agg(F.max("cd")).first()[0] or 0
    credit = seen.where(F.col("dist") == deepest).select("root", "node", F.lit(1.0).alias("credit"))
    flows = None
    for d in range(deepest, 0, -1):
        flow = stages.write(dag.where(F.col("cd") == d).join(credit.select("root", F.col("node").alias("child"), "credit"), ["root", "child"]).select("root", "parent", "child", (F.col("share") * F.col("credit")).alias("flow")))
        flows = flow if flows is None else flows.unionByName(flow)
        gained = flow.groupBy("root", F.col("parent").alias("node")).agg(F.sum("flow").alias("gain"))
        credit = seen.where(F.col("dist") == d - 1).join(gained, ["root", "node"], "left").select("root", "node", (F.coalesce("gain", F.lit(0.0)) + 1).alias("credit"))
    if flows is None:
        return plain.withColumn("betweenness", F.lit(0.0))
    total = flows.groupBy(F.least("parent", "child").alias("src"), F.greatest("parent", "child").alias("dst")).agg(F.round(F.sum("flow") / 2, digits).alias("betweenness"))
    return total


def modularity(current: DataFrame, original: DataFrame, membership: DataFrame, adjacency: str = "current") -> DataFrame:
    """modularity in one row: degrees of ``original``; adjacency of the ``current`` or ``original`` edges. ``membership``: node, component."""
    degree = degrees(original)
    used = both_ways(current if adjacency == "current" else original)
    of = membership.select(F.col("node").alias("src"), F.col("component").alias("cs")), membership.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    inside = used.join(of[0], "src").join(of[1], "dst").where("cs = cd").groupBy(F.col("cs").alias("component")).agg(F.count(F.lit(1)).alias("a"))
    sums = membership.join(degree, "node").groupBy("component").agg(F.sum("degree").alias("k"))
    total = degree.agg(F.sum("degree").alias("m2"))
    return sums.join(inside, "component", "left").crossJoin(F.broadcast(total)).agg(F.sum(F.coalesce("a", F.lit(0)) / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2)).alias("modularity"))


def _scored(label: np.ndarray, a: np.ndarray, b: np.ndarray, degree: np.ndarray, m2: float) -> float:
    """Modularity of a labelling by the adjacency of the edges (a, b)."""
    return 2 * float((label[a] == label[b]).sum()) / m2 - float(((np.bincount(label, degree) / m2) ** 2).sum())


def _split_held(whole: DataFrame, adjacency: str) -> DataFrame:
    spark = whole.sparkSession
    full = g = _held(whole)
    degree, m2 = np.diff(full.first).astype(float), 2.0 * len(full.a)
    best, best_score, count = None, float("-inf"), 0
    while True:
        label = g.labels()
        if len(np.unique(label)) > count:
            used = g if adjacency == "current" else full
            count, score = len(np.unique(label)), _scored(label, used.a, used.b, degree, m2)
            if score > best_score:
                best, best_score = label, score
        if not len(g.a):
            break
        if len(g.nodes) * len(g.a) > 1_000_000:  # worth a job
            value = np.zeros(len(g.a))
            for r in _flows(spark, g).collect():  # a row per edge, whose number was checked
                value[r["edge"]] = r["betweenness"]
        else:
            value = g.flows(np.arange(len(g.nodes))) / 2
        value = np.round(value, 9)
        stay = value < value.max()
        g = Held(full.nodes[g.a[stay]], full.nodes[g.b[stay]], full.nodes)
    kind = whole.schema["src"].dataType.simpleString()
    return spark.createDataFrame(list(zip(full.nodes.tolist(), full.nodes[best].tolist(), strict=True)), f"node {kind}, community {kind}")


def _split_by_joins(whole: DataFrame, adjacency: str, stages: Stages) -> DataFrame:
    current, every = whole, stages.write(vertices(whole))
    best, best_score, count = None, float("-inf"), 0
    while True:
        label = stages.write(every.join(components(current), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        n = label.select("component").distinct().count()
        if n > count:
            count, score = n, modularity(current, whole, label, adjacency).first()[0]
            if score > best_score:
                best, best_score = label, score
        if current.limit(1).count() == 0:
            return best.select("node", F.col("component").alias("community"))
        value = stages.write(_betweenness_by_joins(current, 9))
        current = stages.write(value.where(F.col("betweenness") < value.agg(F.max("betweenness")).first()[0]).select("src", "dst"))


def girvan_newman(edges: DataFrame, adjacency: str = "current", held_edges: int = HELD_EDGES) -> DataFrame:
    """node, community of the split with the highest modularity; community is its smallest node.

    All edges of the largest betweenness (equal to nine digits) go at once; a split is scored when the number of
    components grows; the first best one counts. A graph of at most ``held_edges`` edges is held by the driver, which
    shares out the roots of each search; the rounds of a larger one are joins. The removals follow one another, so
    the rounds grow with the edges whatever the cluster.
    """
    stages = Stages(edges.sparkSession, "girvan-newman")
    whole = stages.write(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    found = whole.limit(held_edges + 1).count()
    if not found:
        return whole.select(F.col("src").alias("node"), F.col("dst").alias("community"))
    return _split_held(whole, adjacency) if found <= held_edges else _split_by_joins(whole, adjacency, stages)
