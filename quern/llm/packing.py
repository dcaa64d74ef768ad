"""Best-fit packing: best-two-fit over the histogram of lengths.

Packing depends on lengths alone, so the driver sees a histogram of at most ``capacity`` entries however
large the corpus is. It fills a bin greedily (the longest piece, then ever the longest that fits), then
puts two unpacked pieces in the place of the bin's smallest one where they fit the expanded gap more
tightly, and applies the bin it got as often as the histogram allows. Pieces find their place by their
rank among the pieces of equal length, which is counted in salted groups: a hot length is no hot task.

Nulls: a null text is an empty document, which still has its end token; a null id stays null. Repeated
rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quern.llm.arrow import as_bytes, id_and_text, map_slices
from quern.llm.token_counts import load_tokenizer
from quern.staging import Stages

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
#: Pieces of one length that one group of the ranking holds, about.
RANK_ROWS = 50_000
#: Texts with characters beyond these go to the tokenizers library itself: its tables and the rank
#: encoder's are the same for them. Very long texts do too, as the rank encoder recurses on them.
_COMMON = re.compile("[^\x00-ɏ]")
_LONG = 1 << 20


@lru_cache(maxsize=2)
def _ranks(path: str, pattern: str, special: tuple):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def byte_bpe_encoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str = "", special: tuple = ()):
    """text -> ids as ``tokenizers`` gives them; with ``ranks_path`` (the same vocabulary) common texts go a faster way."""
    slow = load_tokenizer(tokenizer_path)
    fast = _ranks(ranks_path, pattern, special) if ranks_path else None

    def encode(text: str) -> np.ndarray:
        if fast is not None and len(text) <= _LONG and not _COMMON.search(text):
            return fast.encode_to_numpy(text, allowed_special="all")
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def token_pieces(df: DataFrame, encoder_args: dict, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as token ids plus ``end_id``; only longer ones are cut, the first piece taking the odd rest."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode, end = byte_bpe_encoder(**encoder_args), np.array([end_id], dtype="<u4")
        for part in parts:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                ids = np.concatenate([encode((text or b"").decode()).astype("<u4"), end])
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    n = (len(ids) - 1) % capacity + 1 if k == 0 else capacity
                    for name, v in zip(out, (doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())), strict=True):
                        out[name].append(v)
                    at += n
            yield out

    return map_slices(id_and_text(df, id_col, text_col), work, PIECES)


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, times), which together use up ``histogram`` (length -> count)."""
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    bins: list[tuple[tuple[int, ...], int]] = []

    def largest(most: int, used: dict[int, int]) -> int | None:
        for i in range(bisect_right(lengths, most) - 1, -1, -1):
            if left[lengths[i]] > used.get(lengths[i], 0):
                return lengths[i]
        return None

    while lengths:
        used: dict[int, int] = {}
        items: list[int] = []
        gap = capacity
        while (n := largest(gap, used)) is not None:
            items.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(items) > 1:
            smallest = items[-1]
            room, best, pair = gap + smallest, smallest, None
            for i in range(bisect_right(lengths, room - 1)):
                a = lengths[i]
                if left[a] <= used.get(a, 0):
                    continue
                b = largest(room - a, used | {a: used.get(a, 0) + 1})
                if b is not None and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
            if pair:
                items = items[:-1] + sorted(pair, reverse=True)
        need: dict[int, int] = {}
        for n in items:
            need[n] = need.get(n, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        bins.append((tuple(items), times))
        for n, k in need.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return bins


def _places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple]:
    """length -> arrays of (first rank, first sequence, offset) of its runs of ranks."""
    runs: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for items, times in bins:
        offset = 0
        for n in items:
            runs.setdefault(n, []).append((taken.get(n, 0), base, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` (from 0) among those of equal length."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    salts = counts.select("length", (F.ceil(F.col("n") / RANK_ROWS)).alias("salts"))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    first = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return salted.withColumn("within", within - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("within")).drop("first", "within", "salt")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a written table with ``length`` at most ``capacity``) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(best_two_fit(histogram, capacity))
    ranked = _ranked(pieces)
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, off = places[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema).drop("rank")


def best_fit_packing(df: DataFrame, encoder_args: dict, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    stages = Stages(df.sparkSession, "packing")
    return pack(stages.write(token_pieces(df, encoder_args, end_id, capacity, id_col, text_col)), capacity).select(*PIECES.names, "sequence_id", "offset")
