"""Language-model scoring: an interpolated modified Kneser-Ney model of any order from two on.

The counts are made in Spark. Words become 64-bit hashes; their counts are summed by a shuffle and written as
sorted hash arrays, one file per range of hashes, and a word's place in them, after the frequent words, is its number. N-grams of numbers
are counted per partition, packed (sorted, delta-coded, compressed) and merged per part into sorted arrays of
64-bit n-gram hashes with counts; each merged n-gram then counts once for its last words, which gives the
continuation counts of the next lower order, merged the same way, down to single words. N-grams of a context stay in
one part but for hot contexts, all of whose words are frequent: their n-grams are dealt over all parts by hash, and
their sums meet in a shuffle. The orders follow one another in one job, whose rows are what the next order counts. Whether a context is hot follows from its words' numbers, as frequent words have the lowest.
Contexts that occur once are not stored: one that is a known n-gram and not stored has one follower. Workers open
parts on demand and memory-map them, so a model larger than memory serves.

Of a sorted hash, an index holds the first bits and 32 more are stored, so that a lookup takes another n-gram for its own
with a probability of some 2e-9. Texts begin with order - 1 start marks, which count as words of contexts.

Files lie in the shared folder; where that is no mounted folder, workers read a copy in a folder of their own, which
goes when the worker does. Tasks write under another name and rename, so retried and speculative tasks are harmless.

Words are ASCII-lower-cased runs without ASCII white space; each text has one end token. Nulls: a null text is
empty (its end token is scored); a null id stays null. Unknown words take the uniform share of the lowest order.
Repeated rows count and are scored each; with no training text the model is uniform; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import id_and_text, map_slices
from quern.staging import Stages, Store, fresh_path

SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)
#: The order of the model, of two or more.
ORDER = 3
#: Words of a file of hashes, tokens of a part, tokens counted before a worker packs them, words counted and files opened by a worker.
WORDS_PER_FILE, TOKENS_PER_PART, PACK_TOKENS, MEMO, OPEN = 1 << 20, 2_000_000, 1_500_000, 400_000, 4096
#: No word holds a line break, so these hashes belong to no word.
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n</s>", b"\n<s>"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of a column of texts: ``number`` of each in a row, counted among the ``distinct`` ones, and the ``sizes`` of the texts."""

    def __init__(self, texts: pa.Array):
        if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty piece
        if not filled.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled], minlength=len(sizes))
            words = words.filter(pa.array(filled))
        found = words.dictionary_encode()
        self.sizes, self.number = sizes, found.indices.to_numpy(zero_copy_only=False)
        distinct = found.dictionary
        self.distinct = distinct.view(pa.large_binary() if pa.types.is_large_string(distinct.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))


class Opened(dict):
    """name -> array of a store, opened when asked for; the oldest are closed beyond ``OPEN``."""

    def __init__(self, store: Store, dtype):
        super().__init__()
        self.store, self.dtype = store, dtype

    def __missing__(self, name: str) -> np.ndarray:
        if len(self) >= OPEN:
            del self[next(iter(self))]
        self[name] = out = self.store.get(name, self.dtype)
        return out


class Vocabulary:
    """The words' sorted hashes: file f holds the hashes whose top bits are f; first[f] is the place of its first word.

    A word's number is its place among the ``frequent`` ones' places, if it is one of them, else its place and their number."""

    def __init__(self, store: Store, bits: int, first: list[int], frequent: np.ndarray):
        self.store, self.bits, self.first, self.frequent = store, bits, np.array(first, np.int64), frequent
        self.files = Opened(store, np.uint64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 where unknown."""
        order, h = _order(h)
        files = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        place = np.full(len(h), -1, np.int64)
        cuts = np.flatnonzero(np.r_[True, files[1:] != files[:-1]]) if len(h) else np.empty(0, np.int64)
        for a, b in zip(cuts, np.r_[cuts[1:], len(h)][: len(cuts)], strict=True):
            known = self.files[f"word-hash-{files[a]}"]
            if len(known):
                k = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
                place[a:b] = np.where(known[k] == h[a:b], self.first[files[a]] + k, -1)
        number = np.where(place >= 0, place + len(self.frequent), -1)
        if len(self.frequent):
            k = np.minimum(np.searchsorted(self.frequent, place), len(self.frequent) - 1)
            number = np.where(self.frequent[k] == place, k, number)
        out = np.empty(len(h), np.int64)
        out[order] = number
        return out

    def number(self, h: int) -> int:
        return int(self.numbers(np.array([h], np.uint64))[0])

    def of_words(self, words: Words) -> np.ndarray:
        """Numbers of all words in a row."""
        return self.numbers(words.hashes())[words.number]

    def counts(self, number: np.ndarray) -> np.ndarray:
        """The words' counts; 0 where a number is negative."""
        out, place = np.zeros(len(number), np.int64), number - len(self.frequent)
        often = (number >= 0) & (place < 0)
        place[often] = self.frequent[number[often]]
        of = np.searchsorted(self.first, place, side="right") - 1
        for f in np.unique(of[number >= 0]):
            at = np.flatnonzero((of == f) & (number >= 0))
            if len(known := self.files[f"word-count-{f}"]):
                out[at] = known[place[at] - self.first[f]]
        return out


def _longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hashes of rows with the words ``c`` after them."""
    h = (h ^ (c.astype(np.uint64) + np.uint64(0x9E37))) * _ODD
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of words; that of a context, then a word, is that of the longer row. Nothing for no columns."""
    h = np.zeros(len(columns[0]) if columns else 0, np.uint64)
    for c in columns:
        h = _longer(h, c)
    return h


def indexed(key: np.ndarray) -> np.ndarray:
    """Sorted hashes as 32-bit numbers: the bits b of the index, 2 ** b + 1 places, and of each hash the 32 bits after the first b."""
    b = max(0, len(key).bit_length() - 4)
    first = key >> np.uint64(64 - b) if b else np.zeros(len(key), np.uint64)
    places = np.searchsorted(first, np.arange((1 << b) + 1, dtype=np.uint64))
    return np.concatenate([[b], places, (key >> np.uint64(32 - b)) & np.uint64(0xFFFFFFFF)]).astype(np.uint32)


def find(index: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The places of hashes in ``indexed`` ones, -1 where they are not."""
    b = int(index[0])
    places, stored = index[1 : (1 << b) + 2], index[(1 << b) + 2 :]
    first = (key >> np.uint64(64 - b)).astype(np.int64) if b else np.zeros(len(key), np.int64)
    want = ((key >> np.uint64(32 - b)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    at, end = places[first].astype(np.int64), places[first + 1].astype(np.int64)
    top = len(stored) - 1
    step = 1 << int((end - at).max(initial=0)).bit_length() >> 1
    while step:  # all places are halved together, which is faster than to pick out those still open
        middle = at + (step - 1)
        less = stored[np.minimum(middle, top)] < want
        less &= middle < end
        at += less * np.int64(step)
        step >>= 1
    out = np.full(len(key), -1, np.int64)
    if top >= 0:
        hit = (at < end) & (stored[np.minimum(at, top)] == want)
        out[hit] = at[hit]
    return out


def _part(context: np.ndarray, key: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram: by its context, or by its own hash where the context is hot."""
    return ((np.where(hot, key, context) * _ODD) >> np.uint64(33)).astype(np.int64) % parts


def _squeeze(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes, as most high bytes are zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _expand(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob)).read(), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of unsigned 64-bit numbers, and the numbers in that order.

    The numbers are sorted with their places in their last bits, which is faster than ``argsort``; those that differ in these bits only are put right."""
    last = np.uint64((1 << len(key).bit_length()) - 1)
    held = (key & ~last) | np.arange(len(key), dtype=np.uint64)
    held.sort()
    order = (held & last).view(np.int64)
    out = key[order]
    wrong = np.flatnonzero(out[1:] < out[:-1]).tolist()
    if len(wrong) > 1000:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    end = 0
    for i in wrong:
        if i >= end:
            begin, end = np.searchsorted(held, held[i] & ~last), np.searchsorted(held, held[i] | last, side="right")
            at = begin + np.argsort(out[begin:end], kind="stable")
            order[begin:end], out[begin:end] = order[at], out[at]
    return order, out


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)


def _sorted_by(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The order by part, then by key but for its last bits."""
    bits = int(part.max(initial=0)).bit_length()
    return _order((part.astype(np.uint64) << np.uint64(64 - bits)) | (key >> np.uint64(bits)) if bits else key)[0]


def _rows_summed(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted distinct hashes of rows, the rows, and their summed counts (of one each if not given)."""
    order, key = _order(chained(columns))
    starts = _starts(key)
    first = order[starts]
    if counts is None:
        summed = np.diff(np.r_[starts, len(key)])
    else:
        summed = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return key[starts], [c[first] for c in columns], summed


def count_words(texts: DataFrame) -> DataFrame:
    """h, n: the words of the column ``text`` by hash, END and START once per text."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs = rows = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, h = _order(h)
            starts = _starts(h)
            return h[starts], np.add.reduceat(n[order], starts) if len(starts) else n

        for part in parts:
            words = Words(part.column("text"))
            docs += part.num_rows
            held.append((words.hashes(), np.bincount(words.number, minlength=len(words.distinct))))
            rows += len(words.distinct)
            if rows > 2 * MEMO:
                held = [summed()]
                if (rows := len(held[0][0])) > MEMO:
                    yield {"h": held[0][0].view(np.int64), "n": held[0][1]}
                    held, rows = [], 0
        if held:
            h, n = summed()
            yield {"h": h.view(np.int64), "n": n}
        if docs:
            yield {"h": np.array([END, START], np.uint64).view(np.int64), "n": [docs, docs]}

    pairs = map_slices(texts, work, T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())]))
    return pairs.groupBy("h").agg(F.sum("n").alias("n"))


def _grouped(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of equal ``part`` in sorted batches."""
    rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("part", *columns)), strict=True))
    for part, run in groupby(rows, key=itemgetter(0)):
        yield part, [x[1:] for x in run]


def _write_words(counts: DataFrame, store: Store, bits: int, hot_count: int) -> dict[int, tuple[int, list[int]]]:
    """Write the sorted hash arrays; file -> words, and the places in it of those that are counted oftener than ``hot_count``."""
    part = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = counts.withColumn("part", part).repartition(max(1, 1 << bits), "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        held: list[pa.RecordBatch] = []

        def close() -> None:
            f = held[0].column("part")[0].as_py()
            h, n = (np.concatenate([b.column(c).to_numpy() for b in held]).view(np.uint64) for c in ("h", "n"))
            order = np.argsort(h)
            store.put(f"word-hash-{f}", h[order])
            store.put(f"word-count-{f}", n[order])
            out.append((f, len(h), np.flatnonzero(n[order] > hot_count).tolist()))

        for b in batches:
            p = b.column("part").to_numpy()
            cuts = np.flatnonzero(p[1:] != p[:-1]) + 1
            for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(p)], strict=True):
                piece = b.slice(begin, end - begin)
                if held and piece.num_rows and held[0].column("part")[0] != piece.column("part")[0]:
                    close()
                    held.clear()
                if piece.num_rows:
                    held.append(piece)
        if held:
            close()
        types = {"file": pa.int64(), "words": pa.int64(), "frequent": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types.values())], names=list(types))

    # A row per file; of words counted so often there are fewer than four for each part of tokens, but for START.
    return {r["file"]: (r["words"], r["frequent"]) for r in dealt.select("part", "h", "n").mapInArrow(run, "file long, words long, frequent array<long>").collect()}


class Layout:
    """What a worker needs to open the model; small."""

    def __init__(self, store: Store, bits: int, first: list[int], frequent: np.ndarray, parts: int, tokens: int, order: int):
        self.store, self.bits, self.first, self.frequent, self.parts, self.tokens, self.order = store, bits, first, frequent, parts, tokens, order
        self.words = self.types = 0
        self.lower_mass = 0.0
        self.discounts: dict[int, tuple] = {}

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.store, self.bits, self.first, self.frequent)

    def hot(self, columns: list[np.ndarray]) -> np.ndarray:
        """Whether contexts, a column for each of their words, are hot: of frequent words only, so many that a part would not hold them."""
        out = np.ones(len(columns[0]), bool)
        for c in columns:
            out &= (c >= 0) & (c < len(self.frequent))
        return out


def _columns(numbers: np.ndarray, sizes: np.ndarray, start: int, end: int, order: int) -> list[np.ndarray]:
    """The n-grams of all tokens of texts of so many words each, a column for each of their words."""
    sizes = sizes + 1
    last = np.zeros(sizes.sum(), bool)
    last[np.cumsum(sizes) - 1] = True
    w = np.full(len(last), end, np.int64)
    w[~last] = numbers
    place = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for back in range(order - 1, 0, -1):
        moved = np.full(len(w), start)
        moved[back:] = w[:-back]
        moved[place < back] = start
        out.append(moved)
    return [*out, w]


PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _packed(key: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, layout: Layout) -> dict:
    """PACKED columns for distinct rows of words with their hashes."""
    if len(columns) > 1:
        part = _part(chained(columns[:-1]), key, layout.hot(columns[:-1]), layout.parts)
    else:
        part = _part(key, key, np.ones(len(key), bool), layout.parts)
    bits = max(1, int(columns[0].max(initial=0)).bit_length())
    order = _sorted_by(columns[0].astype(np.uint64) << np.uint64(64 - bits), part)
    part, columns, counts = part[order], [c[order] for c in columns], counts[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(part)][: len(cuts)]
    words = [_squeeze(np.concatenate([np.diff(columns[0][a:b], prepend=0), *(c[a:b] for c in columns[1:])])) for a, b in zip(cuts, ends, strict=True)]
    return {"part": part[cuts].astype(np.int32), "words": words, "counts": [_squeeze(counts[a:b]) for a, b in zip(cuts, ends, strict=True)]}


def _packed_tokens(texts: DataFrame, layout: Layout) -> DataFrame:
    """PACKED counts of the n-grams of the highest order."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        v = layout.vocabulary()
        start, end = v.number(START), v.number(END)
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> dict:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            rows = _rows_summed(rows)
            return _packed(*rows, layout)

        for part in parts:
            words = Words(part.column("text"))
            held.append(_columns(v.of_words(words), words.sizes, start, end, layout.order))
            n += len(held[-1][0])
            if n >= PACK_TOKENS:
                yield flush()
                n = 0
        if held:
            yield flush()

    packed = map_slices(texts, work, PACKED)
    return packed.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in _MERGED.fields[3:]))


_COUNTED = ("t1", "t2", "t3", "t4", "up3", "types", "total")
#: What a merge returns: packed n-grams of the next order (part from 0 on), sums of hot contexts or counts of counts (a negative
#: part; context null) of the order ``m``, which the merges of lower orders pass on.
_MERGED = T.StructType([*PACKED.fields, T.StructField("m", T.IntegerType()), T.StructField("context", T.LongType()), *(T.StructField(c, T.LongType()) for c in _COUNTED)])


def _context_sums(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct contexts with total, n1, n2 and n3 (or more) in columns."""
    order, context = _order(context)
    counts, starts = counts[order], _starts(context)
    each = np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)
    return context[starts], np.add.reduceat(each, starts, axis=0) if len(starts) else each


def _merge(packed: DataFrame, layout: Layout, m: int) -> DataFrame:
    """Write the sorted arrays of the n-grams of ``m`` words and of their contexts; rows as _MERGED says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = layout.vocabulary().number(START)
        for part, blobs in _grouped(batches, *PACKED.names[1:], *_MERGED.names[3:]):
            if part < 0:  # sums of a higher order, to pass on
                yield _merged({"part": [part] * len(blobs), **dict(zip(_MERGED.names[3:], ([x[k] for x in blobs] for k in range(2, len(_MERGED) - 1)), strict=True))})
                continue
            rows: list[list[np.ndarray]] = [[] for _ in range(m)]
            for words, *_ in blobs:
                flat = _expand(words, np.int64).reshape(m, -1)
                for k in range(m):
                    rows[k].append(np.cumsum(flat[0]) if k == 0 else flat[k])
            counts = np.concatenate([_expand(c, np.int64) for _, c, *_ in blobs])
            key, columns, counts = _rows_summed([np.concatenate(r) for r in rows], counts)
            del rows
            layout.store.put(f"gram{m}-key-{part}", indexed(key))
            layout.store.put(f"gram{m}-count-{part}", np.minimum(counts, 255).astype(np.uint8))
            many = np.flatnonzero(counts >= 255)
            layout.store.put(f"gram{m}-many-{part}", np.stack([many, counts[many]]).astype(np.int64))
            out = {c: [int(x)] for c, x in zip(_COUNTED, (*((counts == k).sum() for k in (1, 2, 3, 4)), (counts >= 3).sum(), len(counts), counts.sum()), strict=True)}
            yield _merged({"part": [-1 - part], "m": [m], **out})
            if m == 1:
                continue
            hot = layout.hot(columns[:-1])
            context = chained(columns[:-1])
            names, sums = _context_sums(context[~hot], counts[~hot])
            begins = np.unique(context[columns[m - 2] == start])
            stored = (sums[:, 0] > 1) | np.isin(names, begins)
            # A context that is not hot occurs no oftener than its rarest word, which 32 bits hold.
            layout.store.put(f"context{m}-key-{part}", indexed(names[stored]))
            layout.store.put(f"context{m}-sums-{part}", sums[stored].astype(np.uint32))
            if hot.any():
                names, sums = _context_sums(context[hot], counts[hot])
                yield _merged({"part": -1 - (names >> np.uint64(44)).astype(np.int64), "m": [m] * len(names), "context": names.view(np.int64), "total": sums[:, 0], "t1": sums[:, 1], "t2": sums[:, 2], "up3": sums[:, 3]})
            yield _merged(_packed(*_rows_summed(columns[1:]), layout))

    def _merged(columns: dict) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(_MERGED)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(columns["part"]), f.type) for f in arrow], schema=arrow)

    return packed.repartition(layout.parts, "part").sortWithinPartitions("part").mapInArrow(run, _MERGED)


def _write_hot(merged: DataFrame, layout: Layout, m: int) -> None:
    """Write the sums of the hot contexts, dealt over as many files as there are parts."""
    hot = merged.where((F.col("m") == m) & F.col("context").isNotNull()).groupBy("context").agg(*(F.sum(c).alias(c) for c in ("total", "t1", "t2", "up3")))
    dealt = hot.withColumn("part", F.pmod("context", F.lit(layout.parts)).cast("int")).repartition(layout.parts, "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = 0
        for part, rows in _grouped(batches, "context", "total", "t1", "t2", "up3"):
            table = np.array(rows, np.int64)
            key = table[:, 0].view(np.uint64)
            order = np.argsort(key)
            layout.store.put(f"hot{m}-key-{part}", indexed(key[order]))
            layout.store.put(f"hot{m}-sums-{part}", np.ascontiguousarray(table[order, 1:]))
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()


def discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; half a count where counts of counts are missing."""
    y = t1 / (t1 + 2 * t2) if t1 else 0.0
    raw = [1 - 2 * y * t2 / t1 if t1 and t2 else 0.5, 2 - 3 * y * t3 / t2 if t2 and t3 else 0.5, 3 - 4 * y * t4 / t3 if t3 and t4 else 0.5]
    return tuple(d if 0 < d < k else 0.5 for k, d in enumerate(raw, 1))


def train(texts: DataFrame, stages: Stages, order: int = ORDER) -> Layout:
    """Count and write the model of the column ``text``."""
    if order < 2:
        raise ValueError("the order must be two or more")
    store = Store(fresh_path(texts.sparkSession, "lm"))
    counts = stages.write(count_words(texts))
    apart = ~F.col("h").isin(*(int(np.uint64(x).view(np.int64)) for x in (START,)))
    total = counts.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.when(apart, F.col("n"))), F.lit(0)).alias("tokens")).first()
    bits = max(0, int(np.ceil(np.log2(max(1, total["words"]) / WORDS_PER_FILE))))
    sizes = _write_words(counts, store, bits, TOKENS_PER_PART // 4)
    stages.drop(counts)
    first = np.cumsum([0] + [sizes.get(f, (0,))[0] for f in range((1 << bits) - 1)]).tolist()
    frequent = np.sort(np.array([first[f] + k for f, (_, places) in sizes.items() for k in places], np.int64))
    layout = Layout(store, bits, first, frequent, max(1, -(-total["tokens"] // TOKENS_PER_PART)), total["tokens"], order)
    layout.words = total["words"]
    rows = _packed_tokens(texts, layout)
    for m in range(order, 0, -1):
        rows = _merge(rows, layout, m)
    merged = stages.write(rows.select("m", "context", *_COUNTED))
    counted = {r["m"]: r for r in merged.where("context is null").groupBy("m").agg(*(F.sum(c).alias(c) for c in _COUNTED)).collect()}  # a row per order
    for m in range(1, order + 1):
        t = counted[m].asDict() if m in counted else dict.fromkeys(_COUNTED, 0)
        layout.discounts[m] = d = discounts(t["t1"], t["t2"], t["t3"], t["t4"])
        if m > 1:
            _write_hot(merged, layout, m)
        else:
            layout.types = t["total"]
            layout.lower_mass = (d[0] * t["t1"] + d[1] * t["t2"] + d[2] * t["up3"]) / t["total"] if t["total"] else 1.0
    stages.drop(merged)
    return layout


class Scorer:
    """Scores texts with memory-mapped arrays."""

    def __init__(self, layout: Layout):
        self.layout, self.v = layout, layout.vocabulary()
        self.start, self.end = self.v.number(START), self.v.number(END)
        self.keys, self.small, self.few, self.sums = (Opened(layout.store, t) for t in (np.uint32, np.uint8, np.uint32, np.int64))

    def _find(self, kind: str, key: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, places in ``key``, places in the part's array) of the keys that are found; sorted keys are found fastest."""
        order = _sorted_by(key, part)
        key, part = key[order], part[order]
        cuts = _starts(part)
        for a, b in zip(cuts, np.r_[cuts[1:], len(part)][: len(cuts)], strict=True):
            p = int(part[a])
            if len(known := self.keys[f"{kind}-key-{p}"]):
                k = find(known, key[a:b])
                hit = np.flatnonzero(k >= 0)
                yield p, order[a:b][hit], k[hit]

    def _grams(self, m: int, key: np.ndarray, context: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The counts of n-grams."""
        out = np.zeros(len(key), np.int64)
        for p, at, k in self._find(f"gram{m}", key, _part(context, key, hot, self.layout.parts)):
            got = self.small[f"gram{m}-count-{p}"][k].astype(np.int64)
            if len(more := np.flatnonzero(got == 255)):
                place, count = self.sums[f"gram{m}-many-{p}"].reshape(2, -1)
                got[more] = count[np.searchsorted(place, k[more])]
            out[at] = got
        return out

    def _contexts(self, m: int, key: np.ndarray, hot: np.ndarray, known: np.ndarray, begin: int) -> np.ndarray:
        """total, n1, n2 and n3 in columns; ``known``: the context is an n-gram that something follows; ``begin``: the one of start marks."""
        out = np.zeros((len(key), 4), np.int64)
        out[known, :2] = 1
        asked = known.copy()
        asked[begin] = True
        parts = self.layout.parts
        cold, often = np.flatnonzero(asked & ~hot), np.flatnonzero(asked & hot)
        for p, at, k in self._find(f"context{m}", key[cold], _part(key[cold], key[cold], hot[cold], parts)):
            out[cold[at]] = self.few[f"context{m}-sums-{p}"].reshape(-1, 4)[k]
        for p, at, k in self._find(f"hot{m}", key[often], np.mod(key[often].view(np.int64), parts)):
            out[often[at]] = self.sums[f"hot{m}-sums-{p}"].reshape(-1, 4)[k]
        return out

    @staticmethod
    def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Each distinct n-gram is looked up and scored once; ``gram`` has the n-gram that ends with each token."""
        lay = self.layout
        words = Words(texts)
        n_words = len(words.distinct)
        number = np.r_[self.v.numbers(words.hashes()), self.end, self.start]
        size = words.sizes + 1
        starts = np.cumsum(size) - size
        (token,) = _columns(words.number, words.sizes, n_words + 1, n_words, 1)
        vocabulary = max(0, lay.words - 1)  # without START
        n = self.v.counts(number)
        base = np.log10((n + 0.5) / (lay.tokens + 0.5 * (vocabulary + 1)))
        columns, gram, begin = [number], token, n_words + 1
        key = chained(columns)
        c, at = np.zeros(len(key), np.int64), np.flatnonzero(number >= 0)
        c[at] = self._grams(1, key[at], key[at], np.ones(len(at), bool))
        p = lay.lower_mass / (vocabulary + 1) + (self._discounted(c, lay.discounts[1]) / lay.types if lay.types else np.zeros(len(key)))
        for m in range(2, lay.order + 1):
            known, hot = c > 0, lay.hot(columns)  # a context is the shorter n-gram of the token before, which something follows
            sums = self._contexts(m, key, hot, known, begin)
            sums[~np.logical_and.reduce([x >= 0 for x in columns])] = 0
            total, d = sums[:, 0], lay.discounts[m]
            spare = np.divide(sums[:, 1:] @ np.array(d), total, out=np.ones(len(total)), where=total > 0)
            context = np.r_[begin, gram[:-1]]
            context[starts] = begin
            bits = (len(key) * len(number)).bit_length()
            order, pair = _order((context * len(number) + token).astype(np.uint64) << np.uint64(64 - bits))
            of = _starts(pair)
            one = order[of]  # a token of each distinct n-gram
            lower, context, last = gram[one], context[one], number[token[one]]
            gram = np.empty(len(token), np.int64)
            gram[order] = np.repeat(np.arange(len(of)), np.diff(np.r_[of, len(order)]))
            columns = [*(x[context] for x in columns), last]
            longer = _longer(key[context], last)
            real = np.logical_and.reduce([x >= 0 for x in columns])
            at = np.flatnonzero(real & (c[lower] > 0) & (known[context] | (context == begin)))  # else the n-gram's last words, or its context, were never seen
            c = np.zeros(len(of), np.int64)
            c[at] = self._grams(m, longer[at], key[context[at]], hot[context[at]])
            total = total[context]
            p = np.divide(self._discounted(c, d), total, out=np.zeros(len(total)), where=total > 0) + spare[context] * p[lower]
            if m < lay.order:
                begin = len(of)
                columns, c, p = [np.r_[x, self.start] for x in columns], np.r_[c, 0], np.r_[p, 1.0]
                key = np.r_[longer, chained([x[begin:] for x in columns])]
        return {"n_tokens": size, "n_known": np.add.reduceat((n > 0).astype(np.int64)[token], starts), "train_tokens": np.full(len(size), lay.tokens), "base_score": np.add.reduceat(base[token], starts), "score": np.add.reduceat(np.log10(p)[gram], starts)}


def score(df: DataFrame, layout: Layout, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES per document; a perplexity is 10 ** (-score / n_tokens)."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(layout)
        for part in parts:
            yield {"doc_id": part.column("doc_id"), **scorer(part.column("text"))}

    return map_slices(id_and_text(df, id_col, text_col), work, SCORES)
