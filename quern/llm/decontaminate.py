"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds, windows of ``min_match`` shared words whose rolling
Karp-Rabin values agree and whose words are then compared. For each pair of a document and an item the
longest match that overlaps no marked one is marked, again and again, until none of ``min_match`` words is
left. The item's coverage is the share of its words under marks, whatever their order in the document, so
that reordered passages count. A document is contaminated where an item's coverage reaches the threshold.

The benchmark is a stated query set: it goes to the workers in blocks of a proven size, each block against
all rows, so any benchmark works, one pass over the documents per block. With several blocks the rows are written
once with a number each, and the results of a row meet by that number.

Words: ASCII-lower-cased runs without ASCII white space. An item of fewer than ``min_match`` words is one
seed of all its words; an item or text without words, or null, matches nothing. Repeated documents and
items are handled each; ties between items go to the smaller item_id; an empty benchmark leaves all
documents clean; an empty table gives an empty result; other columns are ignored (or pass through
``drop_contaminated`` as they are).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import as_bytes, filter_slices, id_and_text, map_slices
from quern.staging import Stages

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("covered", T.LongType()),
        T.StructField("item_words", T.LongType()),
        T.StructField("n_items", T.LongType()),
    ]
)
#: Words of a seed, the least coverage of an item, and the words of a benchmark block (some 100 bytes each in a worker).
MIN_MATCH, COVERAGE, BLOCK_WORDS = 5, 0.8, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values (modulo 2**64) of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    x, out = ids.astype(np.uint64) + np.uint64(1), np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * _BASE + (x[k : k + n] ^ (x[k : k + n] << np.uint64(29)))
    return out


def tile(doc: list[int], item: list[int], seeds: list[tuple[int, int]], width: int) -> int:
    """Words of ``item`` under marks. ``seeds``: all (i, j) with doc[i:i+width] == item[j:j+width]."""
    runs: list[tuple[int, int, int]] = []  # the maximal matches: negative length, place in the document, in the item
    by_diagonal = sorted((i - j, i, j) for i, j in seeds)
    for k, (d, i, j) in enumerate(by_diagonal):
        if k and by_diagonal[k - 1][:2] == (d, i - 1):
            runs[-1] = (runs[-1][0] - 1, *runs[-1][1:])
        else:
            runs.append((-width, i, j))
    heapq.heapify(runs)
    in_doc, in_item = set(), bytearray(len(item))
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        free = [not in_item[j + k] and i + k not in in_doc for k in range(n)]
        if all(free):
            in_item[j : j + n] = b"\1" * n
            in_doc.update(range(i, i + n))
            continue
        begin = None
        for k in range(n + 1):  # what is left of it competes anew
            if k < n and free[k]:
                begin = k if begin is None else begin
            elif begin is not None:
                if k - begin >= width:
                    heapq.heappush(runs, (begin - k, i + begin, j + begin))
                begin = None
    return sum(in_item)


class Tiler:
    """Finds the covered items of texts; built in a worker from a block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH, coverage: float = COVERAGE):
        self.min_match, self.coverage = min_match, coverage
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, text in items:
            if words := words_of(text.encode()):
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, ids) in enumerate(self.items):
            width = min(min_match, len(ids))
            for j, h in enumerate(_rolling(np.array(ids), width).tolist()):
                self.seeds[width][h].append((k, j))
        self.hashes = {w: np.sort(np.fromiter(s, np.uint64, len(s))) for w, s in self.seeds.items()}

    def matches(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item_id, covered words, words) of the items whose coverage reaches the threshold."""
        get = self.vocabulary.get
        words = words_of(text)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if not len(ids) or ids.max() < 0:
            return []
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for width, known in self.hashes.items():
            values = _rolling(ids, width)
            at = np.searchsorted(known, values)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == values)
            for i, h in zip(hit.tolist(), values[hit].tolist(), strict=True):
                for k, j in self.seeds[width][h]:
                    if ids[i : i + width].tolist() == self.items[k][1][j : j + width]:
                        pairs[k].append((i, j))
        out = []
        for k, seeds in pairs.items():
            item_id, item = self.items[k]
            covered = tile(ids, item, seeds, min(self.min_match, len(item)))
            if covered >= self.coverage * len(item):
                out.append((item_id, covered, len(item)))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_words`` words; the driver holds one block at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((-1 if r["item_id"] is None else r["item_id"], r["text"]))
        held += len(r["text"]) // 4 + 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(found, key=lambda x: (-x[1] / x[2], x[0]), default=None)


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id (the best covered), covered, item_words, n_items."""
    docs = id_and_text(df, id_col, text_col)
    dealt = list(blocks(benchmark, item_id_col, item_text_col, block_words)) or [[]]
    keyed = len(dealt) > 1
    schema = T.StructType([*SCHEMA, T.StructField("row", T.LongType())]) if keyed else SCHEMA
    if keyed:  # a row's own number, fixed by writing it, as ids may repeat or be null
        docs = Stages(df.sparkSession, "contamination").write(docs.withColumn("row", F.monotonically_increasing_id()))

    def against(items: list[tuple[int, str]]) -> DataFrame:
        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            tiler = Tiler(items, min_match, coverage)
            for part in parts:
                found = [tiler.matches(t) for t in as_bytes(part.column("text"))]
                best = [_best(f) or (None, 0, 0) for f in found]
                yield {**{c: part.column(c) for c in (("doc_id", "row") if keyed else ("doc_id",))}, "contaminated": [bool(f) for f in found], **{n: [b[k] for b in best] for k, n in enumerate(("item_id", "covered", "item_words"))}, "n_items": [len(f) for f in found]}

        return map_slices(docs, work, schema)

    parts = [against(b) for b in dealt]
    if not keyed:
        return parts[0]
    # A row comes from each block; only those with a match say more than the first block's.
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min_by(F.struct("item_id", "covered", "item_words"), F.struct(F.when(F.col("contaminated"), -F.col("covered") / F.col("item_words")).otherwise(F.lit(1.0)), "item_id"))
    merged = every.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.max("contaminated").alias("contaminated"), best.alias("b"), F.sum("n_items").alias("n_items"))
    return merged.select("doc_id", "contaminated", "b.item_id", "b.covered", "b.item_words", "n_items")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` without its contaminated documents; all columns stay."""
    for items in blocks(benchmark, item_id_col, item_text_col, block_words):
        held: list[Tiler] = []

        def clean(part: pa.RecordBatch, items=items, held=held) -> list[bool]:
            if not held:
                held.append(Tiler(items, min_match, coverage))
            return [not held[0].matches(t) for t in as_bytes(part.column(text_col))]

        df = filter_slices(df, clean, text_col)
    return df
