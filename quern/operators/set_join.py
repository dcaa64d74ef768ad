"""Exact set-similarity joins that shuffle neither items of sets nor pairs.

Sets (id, hashes) stand as numbers of their items in files of the shared folder. Files of sets of like size make a block;
a task joins two blocks in memory and returns the pairs that it confirmed on full sets, so that disk grows with the input only.
Items have 64-bit hashes. Those of one set only are counted in its size but not stored, as they are in no intersection.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import Stages, Store, fresh_path

#: Items and members of a file, items of a piece that a task writes, and the bounds of a block's items.
PER_FILE, PIECE, SMALL, LARGE = 1 << 20, 1 << 21, 1 << 18, 1 << 23
#: Pairs and items looked at together by a task.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes and the hashes of all rows in a row."""
    column = batch.column("hashes")
    offsets = column.offsets.to_numpy()
    return batch.column("id").to_numpy(), np.diff(offsets), column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key: equal for equal sets only."""
    for b in batches:
        ids, sizes, hashes = _lists(b)
        row = np.repeat(np.arange(len(ids)), sizes)
        whole = hashes[np.lexsort((hashes, row))].tobytes()
        ends = np.cumsum(sizes) * 8
        named = [hashlib.blake2b(whole[e - 8 * n : e], digest_size=16).digest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(named, pa.binary())], names=["id", "key"])


class Left:
    """The ids of sets that an equal set stands for."""

    def __init__(self, store: Store, files: int):
        self.store, self.files = store, files

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out, of = np.zeros(len(ids), bool), np.mod(ids, self.files)
        for f in np.unique(of):
            at = np.flatnonzero(of == f)
            if len(known := self.store.get(f"member-{f}", np.int64)):
                out[at] = known[np.minimum(np.searchsorted(known, ids[at]), len(known) - 1)] == ids[at]
        return out


def _write_members(members: DataFrame, store: Store) -> Left:
    files = 1 + members.count() // PER_FILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, ids in zip(b.column("file").to_pylist(), b.column("ids"), strict=True):
                store.put(f"member-{f}", np.sort(ids.values.to_numpy()))
            yield b.select(["file"])

    members.groupBy(F.pmod("member", F.lit(files)).alias("file")).agg(F.collect_list("member").alias("ids")).mapInArrow(run, "file long").count()
    return Left(store, files)


class Vocabulary:
    """Sorted hashes of the items of two sets or more: file f holds those whose top bits are f; first[f] is the number of its first item."""

    def __init__(self, store: Store, bits: int, words: dict[int, int]):
        self.store, self.bits = store, bits
        self.first = np.cumsum([0] + [words.get(f, 0) for f in range(1 << bits)])
        if self.first[-1] >= 1 << 32:
            raise ValueError("more than 2 ** 32 different items in two sets or more")

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How common the items are, in steps, and their numbers; -1 where only one set has them."""
        order = np.argsort(h)
        h = h[order]
        step, number = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        cuts = np.searchsorted(h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)) if self.bits else np.array([0, len(h)])
        for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            known = self.store.get(f"item-{f}", np.uint64) if a < b else h[:0]
            if len(known):
                k = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
                found = known[k] == h[a:b]
                number[order[a:b]] = np.where(found, self.first[f] + k, -1)
                step[order[a:b]] = self.store.get(f"step-{f}", np.uint8)[k]
        return step, number


def _write_items(sets: DataFrame, left: Left, store: Store, stages: Stages) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            ids, sizes, hashes = _lists(b)
            held.append(hashes[np.repeat(~left(ids), sizes)])
            if sum(map(len, held)) >= 2 * PIECE:
                yield flush()
        if held:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, h, n in zip(b.column("file").to_pylist(), b.column("h"), b.column("n"), strict=True):
                h, n = h.values.to_numpy().view(np.uint64), n.values.to_numpy()
                order = np.argsort(h)
                store.put(f"item-{f}", h[order])
                store.put(f"step-{f}", np.minimum(4 * np.log2(n[order]), 255).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([len(h)], pa.int64())], names=["file", "words"])

    counted = stages.write(sets.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    bits = max(0, (counted.count() // PER_FILE).bit_length())
    of = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    each = counted.groupBy(of.alias("file")).agg(F.collect_list(F.struct("h", "n")).alias("all")).select("file", F.col("all.h").alias("h"), F.col("all.n").alias("n"))
    words = {r["file"]: r["words"] for r in each.mapInArrow(write, "file long, words long").collect()}  # a row per file
    stages.drop(counted)
    return Vocabulary(store, bits, words)


class Sets:
    """Sets by size, then id: ids, n (items), k (stored items), their numbers in a row from rare to common, and ``bands`` of keys each."""

    def __init__(self, pieces: list[tuple], bands: int):
        ids, keys, n, k, items = (np.concatenate(x) for x in zip(*pieces, strict=True))
        order = np.lexsort((ids, n))
        self.ids, self.n, self.k = ids[order], n[order].astype(np.int64), k[order].astype(np.int64)
        self.keys = keys.reshape(-1, bands)[order] if bands else None
        self.start = _starts(self.k)
        self.items = items[self.spread(_starts(k.astype(np.int64))[order], self.k)]

    @staticmethod
    def spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places from ``start`` on, as many as ``sizes`` says."""
        return np.arange(sizes.sum()) + np.repeat(start - _starts(sizes), sizes)

    def entries(self, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, sets and places of those of the first n - ceil(share n) + 1 items that are stored; all keys of bands if there are any."""
        if self.keys is not None:
            return self.keys.ravel(), np.repeat(np.arange(len(self.n)), self.keys.shape[1]), np.zeros(self.keys.size, np.int64)
        before = self.n - self.k  # items of this set only are the rarest
        sizes = np.clip(self.n - np.ceil(share * self.n - 1e-9).astype(np.int64) + 1 - before, 0, self.k)
        row = np.repeat(np.arange(len(self.n)), sizes)
        at = self.spread(self.start, sizes)
        return self.items[at], row, at - self.start[row] + before[row]

    def bitmaps(self, bits: int) -> np.ndarray:
        """For each set the parities of its items in ``bits`` groups; two sets differ in as many items as parities, or more."""
        place = ((self.items.astype(np.uint64) * _ODD) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
        odd = np.zeros((len(self.n), bits), np.uint8)
        for a in range(0, len(self.n), step := max(1, (CHUNK << 2) // bits)):
            part = slice(self.start[a], self.start[a + step] if a + step < len(self.n) else len(place))
            row = np.repeat(np.arange(len(self.n[a : a + step])), self.k[a : a + step])
            odd[a : a + step] = (np.bincount(row * bits + place[part], minlength=len(self.n[a : a + step]) * bits) & 1).reshape(-1, bits)
        return np.packbits(odd, axis=1).view(np.uint64)


def _bits(n: int) -> int:
    """Groups of the bitmaps of sets of up to ``n`` items."""
    return 1 << min(13, max(7, n.bit_length() + 1))


class Index:
    """The entries of sets by key, then set."""

    def __init__(self, sets: Sets, share: float):
        keys, row, place = sets.entries(share)
        order = np.lexsort((row, keys))
        self.sets = sets
        keys, self.row, self.place = keys[order], row[order], place[order]
        self.keys, number = np.unique(keys, return_inverse=True)
        self.entry = number * (len(sets.n) + 1) + self.row
        self._bitmaps: dict[int, np.ndarray] = {}

    def bitmaps(self, bits: int) -> np.ndarray:
        if bits not in self._bitmaps:
            self._bitmaps = {bits: self.sets.bitmaps(bits)}
        return self._bitmaps[bits]


def _confirmed(x: Sets, y: Sets, xs: np.ndarray, ys: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs sorted by ``xs`` those that are similar, with their similarity."""
    cuts = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        one = xs[a]
        items = np.sort(x.items[x.start[one] : x.start[one] + x.k[one]])
        many = max(1, CHUNK // max(1, int(y.k[ys[a:b]].max())))
        for c in range(a, b, many):
            two = ys[c : min(b, c + many)]
            flat = y.items[Sets.spread(y.start[two], y.k[two])]
            same = items[np.minimum(np.searchsorted(items, flat), len(items) - 1)] == flat
            common = np.add.reduceat(same, _starts(y.k[two]), dtype=np.int64)
            similarity = common / (x.n[one] + y.n[two] - common)
            kept = similarity >= t
            yield np.full(kept.sum(), x.ids[one]), y.ids[two[kept]], similarity[kept]


def _joined(x: Sets, index: Index, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similar pairs of a set of ``x`` and one of the index that comes after it by size, then id."""
    y = index.sets
    keys, row, place = x.entries(2 * t / (1 + t))
    order = np.argsort(keys, kind="stable")
    keys, row, place = keys[order], row[order], place[order]
    if not len(index.keys) or not len(keys):
        return
    k = np.minimum(np.searchsorted(index.keys, keys), len(index.keys) - 1)
    hit = index.keys[k] == keys
    k, row, place = k[hit], row[hit], place[hit]
    low = np.searchsorted(y.n, x.n)
    high = np.searchsorted(y.n, np.floor(x.n / t + 1e-9), side="right")
    begin, end = (np.searchsorted(index.entry, k * (len(y.n) + 1) + edge[row]) for edge in (low, high))
    sizes = end - begin
    some = sizes > 0
    row, place, begin, sizes = row[some], place[some], begin[some], sizes[some]
    banded = x.keys is not None
    bits = _bits(int(max(x.n.max(), y.n.max())))
    bx, by = x.bitmaps(bits), index.bitmaps(bits)
    met, total = [], np.cumsum(sizes)
    width = max(1 << 12, CHUNK // bx.shape[1])
    begins = 0
    while begins < len(sizes):
        ends = max(begins + 1, int(np.searchsorted(total, (total[begins - 1] if begins else 0) + CHUNK, side="right")))
        part = slice(begins, ends)
        begins = ends
        at = Sets.spread(begin[part], sizes[part])
        xs, ys = np.repeat(row[part], sizes[part]), index.row[at]
        nx, ny = x.n[xs], y.n[ys]
        need = np.ceil(t / (1 + t) * (nx + ny) - 1e-9)
        ok = (nx < ny) | (x.ids[xs] < y.ids[ys])
        if not banded:
            ok &= np.minimum(nx - np.repeat(place[part], sizes[part]), ny - index.place[at]) >= need
        xs, ys, need = xs[ok], ys[ok], need[ok]
        spare = x.k[xs] + y.k[ys] - 2 * need
        ok = spare >= 0
        for a in range(0, len(xs), width):
            s = slice(a, a + width)
            ok[s] &= np.bitwise_count(bx[xs[s]] ^ by[ys[s]]).sum(axis=1, dtype=np.int64) <= spare[s]
        met.append(np.unique(xs[ok] * len(y.n) + ys[ok]))
        if sum(map(len, met)) > 4 * CHUNK:
            met = [np.unique(np.concatenate(met))]
    pairs = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
    if len(pairs):
        yield from _confirmed(x, y, pairs // len(y.n), pairs % len(y.n), t)


def similar_sets(sets: DataFrame, members: DataFrame, threshold: float, stages: Stages, bands: int = 0, band_keys: Callable | None = None) -> DataFrame:
    """a < b, similarity of the sets (id long, hashes) that are no member, from ``threshold`` on; given ``band_keys`` (of the sets' starts
    and hashes), only of those that agree in one of them.

    Exact by prefixes and positions: of a similar pair the smaller set's first ``n - ceil(2t/(1+t) n) + 1`` items and the larger
    set's first ``n - ceil(t n) + 1``, from rare to common, hold their first common item, after which both must have enough items left.
    """
    t, spark = threshold, sets.sparkSession
    store = Store(fresh_path(spark, "sets"))
    left = _write_members(members, store)
    vocabulary = _write_items(sets, left, store, stages)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def flush() -> pa.RecordBatch:
            out = []
            for size, pieces in held.items():
                ids, keys, n, k, items = (np.concatenate(x) for x in zip(*pieces, strict=True))
                out.append((uuid.uuid4().hex, size, len(ids), len(items)))
                store.put(out[-1][0], np.concatenate([ids.view(np.uint32), keys.view(np.uint32), n, k, items]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), *[pa.int64()] * 3))], names=["name", "size", "sets", "items"])

        n_held = 0
        for b in batches:
            ids, n, hashes = _lists(b)
            whole = ~left(ids)
            hashes, ids, n = hashes[np.repeat(whole, n)], ids[whole], n[whole]
            for a in range(0, len(ids), 1 << 14):
                i, size = ids[a : a + (1 << 14)], n[a : a + (1 << 14)]
                h = hashes[n[:a].sum() : n[:a].sum() + size.sum()]
                keys = band_keys(_starts(size), h) if band_keys else np.empty((len(i), 0), np.uint64)
                step, number = vocabulary(h)
                row = np.repeat(np.arange(len(i)), size)
                known = number >= 0
                k = np.bincount(row[known], minlength=len(i))
                items = np.sort((row[known] << 40) | (step[known] << 32) | number[known]).astype(np.uint32)
                of = np.frexp(size)[1]
                for c in np.unique(of).tolist():
                    at = of == c
                    held.setdefault(c, []).append((i[at], keys[at].ravel(), size[at].astype(np.uint32), k[at].astype(np.uint32), items[np.repeat(at, k)]))
                n_held += len(items) + keys.size
            if n_held >= PIECE:
                yield flush()
                n_held = 0
        if held:
            yield flush()

    pieces = sets.mapInArrow(encode, "name string, size long, sets long, items long").collect()  # a row per file
    full = min(LARGE, max(SMALL, sum(p["items"] + bands * p["sets"] for p in pieces) // 64))
    blocks: list[tuple[int, list]] = []
    for size in sorted({p["size"] for p in pieces}):
        weight = full
        for name, _, n, items in sorted(p for p in pieces if p["size"] == size):
            if weight >= full:
                blocks.append((size, []))
                weight = 0
            blocks[-1][1].append((name, n))
            weight += items + bands * n
    # Sizes of one number of bits; a set is joined with sets of its size to size / t.
    pairs = [(i, j) for j, (y, _) in enumerate(blocks) for i, (x, _) in enumerate(blocks) if x <= y and (1 << (y - 1)) * t <= (1 << x) - 1 + 1e-9]

    def opened(block: int) -> Sets:
        out = []
        for name, n in blocks[block][1]:
            a = store.get(name, np.uint32)
            at = np.cumsum([2 * n, 2 * n * bands, n, n])
            ids, keys, size, k, items = np.split(a, at)
            out.append((ids.view(np.int64), keys.view(np.uint64), size, k, items))
        return Sets(out, bands)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = -1, None
        for b in batches:
            for p in b.column("id").to_pylist():
                i, j = pairs[p]
                if j != last:
                    last, index = j, Index(opened(j), t)
                held: list[tuple] = []
                for found in _joined(opened(i) if i != j else index.sets, index, t):
                    held.append(found)
                    if sum(len(f[0]) for f in held) >= CHUNK or len(held) >= 1024:
                        yield _rows(held)
                if held:
                    yield _rows(held)

    def _rows(held: list[tuple]) -> pa.RecordBatch:
        x, y, similarity = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(similarity)], names=["a", "b", "similarity"])

    tasks = spark.range(0, len(pairs), 1, max(1, min(len(pairs), 512)))
    return tasks.mapInArrow(join, "a long, b long, similarity double")
