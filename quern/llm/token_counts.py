"""Token counts by overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
common token boundary that is proven stable: the character before it is ASCII white space, which the
tokenizer's normaliser and pre-tokenizer never join with what follows, and both chunks have the same ids
at the same offsets between that boundary and the common boundary before it. Where the overlap holds no
such place it is widened, up to the whole rest of the document, so the count always equals that of a
single encoding while memory follows the chunk. Shorter documents are encoded word by word (white space
is a stable boundary there too), each distinct word of a slice once.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id stays null. Repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.arrow import as_bytes, id_and_text, map_slices

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
        T.StructField("n_splices", T.LongType()),
    ]
)
#: Characters of a chunk, and of the first overlap tried between two chunks.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 10
#: Distinct words remembered by a worker; beyond that it starts anew.
MEMO_WORDS = 400_000
_SPACE = " \t\n\r\x0b\x0c"

Encode = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a .json file, as the library gives it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(path: str) -> Encode:
    """Ids and character offsets of a text, without added special tokens."""
    tokenizer = load_tokenizer(path)

    def encode(text: str):
        e = tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    return encode


def _common_boundary(text: str, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], begin: int) -> int | None:
    """The last position at or after ``begin`` where the two streams of (start, end, id) may be spliced, or None."""
    starts = {s for s, _, _ in right}
    common = sorted({s for s, _, _ in left if s >= begin and s in starts and s > 0 and text[s - 1] in _SPACE})
    for before, p in zip(common[-2::-1], common[:0:-1], strict=False):
        if [t for t in left if before <= t[0] < p] == [t for t in right if before <= t[0] < p]:
            return p
    return None


def encode_spliced(text: str, encode: Encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], int]:
    """The ids of ``text``, equal to those of one encoding, and the number of splices."""

    def absolute(begin: int, end: int) -> list[tuple[int, int, int]]:
        ids, offsets = encode(text[begin:end])
        return [(begin + s, begin + e, i) for i, (s, e) in zip(ids, offsets, strict=True)]

    out: list[int] = []
    splices, n = 0, len(text)
    begin, end = 0, min(chunk, n)
    current = absolute(begin, end)
    while end < n:
        width = overlap
        while True:
            at = max(begin, end - width)
            if at == begin:  # the overlap reached a proven boundary: take a larger chunk from there
                end = min(n, begin + 2 * (end - begin))
                current = absolute(begin, end)
                break
            ahead = absolute(at, min(n, at + chunk + width))
            p = _common_boundary(text, current, ahead, at)
            if p is not None:
                out += [i for s, _, i in current if s < p]
                current, begin, end = [t for t in ahead if t[0] >= p], p, min(n, at + chunk + width)
                splices += 1
                break
            width *= 4
    return out + [i for _, _, i in current], splices


class WordCounter:
    """Tokens of short texts; each distinct word is encoded once per worker."""

    def __init__(self, path: str):
        self.tokenizer, self.memo = load_tokenizer(path), {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]  # bytes.split: at ASCII white space only
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if new := list(set().union(*words) - self.memo.keys()):
            for w, e in zip(new, self.tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
                self.memo[w] = len(e)
        get = self.memo.__getitem__
        return [sum(map(get, w)) for w in words]


def token_counts(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_splices.

    ``tokenizer_path`` is a .json file whose tokens never hold white space together with what follows it.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode, count = encoder(tokenizer_path), WordCounter(tokenizer_path)
        for part in parts:
            texts = [t or b"" for t in as_bytes(part.column("text"))]
            tokens, splices = [0] * len(texts), [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            for i, n in zip(short, count([texts[i] for i in short]), strict=True):
                tokens[i] = n
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    ids, splices[i] = encode_spliced(t.decode(), encode, chunk_chars, overlap_chars)
                    tokens[i] = len(ids)
            yield {"doc_id": part.column("doc_id"), "n_bytes": [len(t) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens], "n_splices": splices}

    return map_slices(id_and_text(df, id_col, text_col), work, SCHEMA)
