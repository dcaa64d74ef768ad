"""MinHash near-deduplication with circulant signatures.

Shingles are five-word windows, hashed to 64 bits; a document's set is the sorted distinct hashes. Circulant
MinHash needs two permutations of the 32-bit universe: ``sigma`` shuffles the shingles once, and coordinate k
of the signature is the smallest value of ``pi`` shifted circularly by k, so no family of hash functions is
kept. Documents of equal sets are one class. Classes share a band bucket if some ``ROWS`` coordinates agree.

Links are found without emitting the pairs of a bucket. First every class is compared with the hub of each
of its buckets, its most central class, which joins the bulk of any group of near copies. Then only buckets whose classes still lie in
different components are searched, in blocks that a worker holds with their texts: pairs of two components that agree on
enough coordinates are compared on full sets there, until the components are joined or no pair is left, and only links that
join two components leave the worker. So a bucket gives fewer rows than it has classes, however many of its pairs lie just
below the threshold. Blocks are bounded in classes and in shingles. With ``hand_on`` texts stay out of the blocks: workers
hand on the most alike pairs of two components by signatures alone, to be confirmed, in rounds of 64 times as many; that
moves less where texts are long and few pairs lie just below the threshold. Both give the same components. A pair at the threshold escapes all bands with
probability 2e-6 (3e-6 for ``AT_80``) and the signature test with 3e-7; dissimilar pairs are never linked.

Nulls: a null text has no words; a document without words is linked with nothing. A null id is an id of no
rank: its row gets its component's smallest id. Rows that repeat an id are judged each and equal texts fall
into one class; ties go to the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import as_bytes, id_and_text, map_slices
from quern.operators.components import connected_components
from quern.staging import Stages

SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("signature", T.BinaryType()),
    ]
)
CHECKED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("common", T.LongType()), T.StructField("united", T.LongType())])
#: Words of a shingle; rows of a band and bands for links from 85 percent on, and for links from 80 percent on.
WIDTH, AT_85, AT_80 = 5, (6, 28), (5, 32)
#: Standard deviations below the expected agreement of a pair at the threshold from which a pair is not confirmed.
DEVIATIONS = 5.0
#: Classes of a block when a bucket is searched, about, and pairs of two components that a block hands on in the first round.
BLOCK, FIRST_PAIRS = 2048, 64
#: Shingles of a block that is held with its texts, about.
BLOCK_SHINGLES = 1 << 21
#: Pairs with one hub that one group confirms, shingles hashed at once, words remembered.
HUB_PAIRS, CHUNK, MEMO = 256, 1 << 16, 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: _Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * _A
        out ^= out >> np.uint64(32)
    out *= _B
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]] if n > 1 else out


def node_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of 32-bit coordinates for each."""
    out = np.empty((len(sets), coordinates), np.uint32)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (end == begin or held + len(sets[end]) <= CHUNK):
            held += len(sets[end])
            end += 1
        shingles = np.concatenate(sets[begin:end])
        starts = np.cumsum([0] + [len(s) for s in sets[begin : end - 1]])
        sigma = _mix((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
        for k in range(coordinates):
            out[begin:end, k] = np.minimum.reduceat(_mix(sigma - np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
        begin = end
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands; the band's number is part of its key."""
    bands = signature.shape[1] // rows
    out = np.arange(1, bands + 1, dtype=np.uint64) * _B + np.zeros((len(signature), 1), np.uint64)
    for r in range(rows):
        out = (out ^ signature[:, r : bands * rows : rows]) * _A
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def sign(df: DataFrame, rows: int, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SIGNED per document; a document without words has node, bands and signature null."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = _Words()
        for part in parts:
            sets = [shingle_set(t, words) for t in as_bytes(part.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            node, keys, low = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                values = signatures([sets[i] for i in full], rows * bands)
                for i, k, v in zip(full, band_keys(values, rows), values.astype(np.uint8), strict=True):
                    node[i], keys[i], low[i] = node_of(sets[i]), k, v.tobytes()
            yield {"doc_id": part.column("doc_id"), "n_shingles": [len(s) for s in sets], "node": node, "bands": keys, "signature": low}

    return map_slices(id_and_text(df, id_col, text_col), work, SIGNED)


def _agreeing(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree on ``least`` coordinates or more."""
    sides = pairs.join(classes.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(classes.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in ("sa", "sb"))
                yield t.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return sides.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, stages: Stages) -> DataFrame:
    """CHECKED for pairs (a, b) of nodes, a written table; ``texts``: node, text. Pairs of one hub are dealt out in salted groups."""
    crowded = stages.write(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("salts")).where("salts > 1"))
    salted = stages.write(pairs.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt")))
    members = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    hubs = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    dealt = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hub = _Words(), np.empty(0, np.uint64)
        for t in batches:
            out: list[tuple] = []
            for a, kind, b, text in zip(t.column("a").to_pylist(), t.column("kind").to_pylist(), t.column("b").to_pylist(), as_bytes(t.column("text")), strict=True):
                own = shingle_set(text, words)
                if kind == 0:
                    hub = own
                else:
                    common = len(np.intersect1d(hub, own, assume_unique=True))
                    out.append((a, b, common, len(hub) + len(own) - common))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=CHECKED.names)

    return dealt.mapInArrow(run, CHECKED)


_HANDED = "a long, b long, more boolean"


def _search(crowded: DataFrame, least: int, percent: int, most: int) -> DataFrame:
    """a, b: pairs across components within buckets whose sizes and signatures allow a link, at most ``most`` for two components.

    ``crowded``: bucket, band, node, component, n_shingles, bands, signature, block, blocks. Blocks of a bucket meet in
    pairs, so a worker holds two of them. A pair is looked at in the first bucket that both share. A row with ``more``
    (and no pair) says that a group has further pairs.
    """
    rounds = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = rounds.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi, band = (int(group[c].iloc[0]) for c in ("lo", "hi", "band"))
        group = group.drop_duplicates("node").sort_values(["block", "node"], kind="stable")
        node, component, size, block = (group[c].to_numpy() for c in ("node", "component", "n_shingles", "block"))
        s, keys = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1), np.stack(group["bands"].to_list())
        found = []
        for i in np.flatnonzero(block == lo) if lo != hi else range(len(group)):
            j = np.flatnonzero(block == hi) if lo != hi else np.arange(i + 1, len(group))
            j = j[(component[j] != component[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            if len(j):
                same = (s[j] == s[i]).sum(axis=1)
                j, same = j[same >= least], same[same >= least]
                first = ~(keys[j, :band] == keys[i, :band]).any(axis=1)  # else the pair met in the bucket of an earlier band
                found.append(np.stack([np.full(first.sum(), i), j[first], same[first]]))
        i, j, same = np.concatenate([np.empty((3, 0), np.int64), *found], axis=1)
        x, y = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        order = np.lexsort((node[j], node[i], -same, y, x))
        i, j, x, y = i[order], j[order], x[order], y[order]
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(i) else np.empty(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        out = pd.DataFrame({"a": node[i[rank < most]], "b": node[j[rank < most]], "more": False}).astype({"a": "Int64", "b": "Int64"})
        if (rank >= most).any():
            out = pd.concat([out, pd.DataFrame({"a": [None], "b": [None], "more": [True]}).astype({"a": "Int64", "b": "Int64"})])
        return out

    return meet.drop("other", "blocks").groupBy("bucket", "lo", "hi").applyInPandas(run, _HANDED)


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of a non-empty set with others."""
    every = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    return np.add.reduceat(hit, np.cumsum([0] + [len(o) for o in others[:-1]]), dtype=np.int64)


def _joining(crowded: DataFrame, least: int, percent: int) -> DataFrame:
    """src, dst: links that join the components of each bucket as far as full sets allow, each joining two.

    ``crowded``: bucket, band, node, component, n_shingles, bands, signature, text, block, blocks. Blocks of a bucket meet
    in pairs, so a worker holds two of them. A pair is looked at in the first bucket that both share.
    """
    rounds = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = rounds.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi, band = (int(group[c].iloc[0]) for c in ("lo", "hi", "band"))
        group = group.drop_duplicates("node").sort_values(["block", "node"], kind="stable")
        node, size, block, text = (group[c].to_numpy() for c in ("node", "n_shingles", "block", "text"))
        root = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        s, keys = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1), np.stack(group["bands"].to_list())
        words, sets, found = _Words(), {}, []
        for i in np.flatnonzero(block == lo) if lo != hi else range(len(group)):
            j = np.flatnonzero(block == hi) if lo != hi else np.arange(i + 1, len(group))
            j = j[(root[j] != root[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            j = j[(s[j] == s[i]).sum(axis=1) >= least]
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]  # else the pair met in the bucket of an earlier band
            if len(j):
                for k in (i, *j):
                    if k not in sets:
                        sets[k] = shingle_set(text[k].encode(), words)
                common = _common(sets[i], [sets[k] for k in j])
                for k in j[100 * common >= percent * (size[i] + size[j] - common)]:
                    if root[k] != root[i]:
                        found.append((node[i], node[k]))
                        root[root == root[k]] = root[i]
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return meet.drop("other", "blocks").groupBy("bucket", "lo", "hi").applyInPandas(run, "src long, dst long")


def least_agreeing(percent: int, coordinates: int) -> int:
    """Agreeing coordinates, one byte each, that a pair at the threshold falls short of with negligible probability."""
    p = percent / 100
    return int(coordinates * p - DEVIATIONS * (coordinates * p * (1 - p)) ** 0.5)


def near_duplicates(df: DataFrame, percent: int = 85, shape: tuple[int, int] = AT_85, id_col: str = "doc_id", text_col: str = "text", hand_on: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Documents are linked if 100 * common shingles >= percent * united shingles.
    """
    spark = df.sparkSession
    stages = Stages(spark, "near-dedup")
    rows, bands = shape
    least = least_agreeing(percent, rows * bands)
    signed = stages.write(sign(df, rows, bands, id_col, text_col))
    classes = stages.write(
        signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "bands", "signature"), "node").alias("s")).select("node", "doc_id", "s.n_shingles", "s.bands", "s.signature")
    )
    linkable = (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    entries = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowds = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded_entries = stages.write(entries.join(crowds, "bucket"))
    # The hub of a bucket is its most central class, the one that meets most classes over all its buckets.
    central = crowded_entries.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = stages.write(crowded_entries.join(central, "node"))
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("met", "node", "n_shingles")).alias("top")).select("bucket", F.col("top.node").alias("hub"), F.col("top.n_shingles").alias("n_a"))
    shared = stages.write(ranked.drop("met").join(hubs, "bucket"))
    stars = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "n_a", F.col("n_shingles").alias("n_b")).where(linkable).select("a", "b").distinct()
    pairs = stages.write(_agreeing(stars, classes, least))
    # Texts that any comparison may need: those of classes that share a bucket with another. One text stands for a class.
    members = shared.select("node").distinct().join(classes.select("node", "doc_id"), "node")
    texts = stages.write(_texts_of(members, id_and_text(df, id_col, text_col)))
    linked = (F.lit(100) * F.col("common") >= F.lit(percent) * F.col("united"))
    links = stages.write(confirm(pairs, texts, stages).where(linked).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    joined = connected_components(links, stages)
    if not hand_on:
        split = shared.select("bucket", "band", "node", "n_shingles").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))
        sums = F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")
        several = split.groupBy("bucket").agg(*sums).where("c0 <> c1 and members > 2").select("bucket", blocks.alias("blocks"))
        held = classes.select("node", "bands", "signature").join(texts.dropDuplicates(["node"]), "node")
        crowded = split.join(several, "bucket").join(held, "node").select("bucket", "band", "node", "component", "n_shingles", "bands", "signature", "text", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks")
        fresh = stages.write(_joining(crowded, least, percent))
        if fresh.limit(1).count():
            joined = connected_components(stages.write(links.unionByName(fresh)), stages)
    most = FIRST_PAIRS
    while hand_on:
        split = shared.select("bucket", "band", "node", "n_shingles").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = split.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("members")).where("c0 <> c1 and members > 2").select("bucket", F.ceil(F.col("members") / BLOCK).alias("blocks"))
        crowded = split.join(several, "bucket").join(classes.select("node", "bands", "signature"), "node").select("bucket", "band", "node", "component", "n_shingles", "bands", "signature", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks")
        handed = stages.write(_search(crowded, least, percent, most))
        fresh = stages.write(confirm(handed.where("not more").select("a", "b"), texts, stages).where(linked).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        if fresh.limit(1).count():
            links = links.unionByName(fresh)
            joined = connected_components(stages.write(links), stages)
        if handed.where("more").limit(1).count() == 0:
            break
        most *= 64
    labelled = classes.select("node", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = labelled.join(smallest, "component").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text for the nodes of ``members`` (node, doc_id); a node may come several times, with texts of equal sets."""
    named = members.join(docs, "doc_id").select("node", "text")
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for t in batches:
            own = [node_of(s) if len(s := shingle_set(x, words)) else None for x in as_bytes(t.column("text"))]
            keep = [o is not None and n in (None, o) for n, o in zip(t.column("node").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), t.column("text")], names=["node", "text"]).filter(pa.array(keep, pa.bool_()))

    return named.unionByName(unnamed).mapInArrow(run, "node long, text string")
