"""Language identification by hierarchical discrimination.

A linear model predicts the language family first; within the family one-versus-one linear support vector
machines separate the related languages, by votes and, on equal votes, by the sum of margins. Features are
hashed byte trigrams and two-grams of the whole text, letters only, scaled to unit length. The models are
fitted on the driver from a sample of labelled rows of at most about ``sample_docs`` per language;
everything else, all predictions included, covers whole texts.

A learned value that the family table does not know is a family of its own. Nulls: a null text or one
without a letter gives ``und`` with score 0; a null label is not learned. Without any label all rows are
``und``. Repeated rows are predicted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import as_bytes, id_and_text, map_slices

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("family", T.StringType())])
#: Buckets of the feature hash, and labelled documents per language that the models are fitted on, at most about.
BUCKETS, SAMPLE_DOCS = 1 << 14, 800
#: Families of common languages (ISO 639-1).
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "mk", "be", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: ASCII other than letters becomes a space; bytes of longer characters stay.
_LETTERS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def vector(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The feature vector of a whole text, of length one (or zero)."""
    b = np.frombuffer(b" " + text.lower().translate(_LETTERS) + b" ", dtype=np.uint8).astype(np.uint32)
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    codes = np.concatenate([two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA77)]) >> np.uint32(32 - (buckets.bit_length() - 1))
    x = np.sqrt(np.bincount(codes, minlength=buckets)).astype(np.float32)
    n = float(np.sqrt(x @ x))
    return x / n if n else x


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return bool(text.translate(_LETTERS).strip())
    return bool(_LETTER.search(text.decode()))


class Rows:
    """Feature vectors kept sparse; a batch becomes dense when it is used."""

    def __init__(self, texts: list[bytes], buckets: int = BUCKETS):
        self.buckets = buckets
        self.rows = []
        for t in texts:
            x = vector(t, buckets)
            at = np.flatnonzero(x)
            self.rows.append((at.astype(np.uint32), x[at]))

    def __call__(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.buckets), np.float32)
        for k, i in enumerate(which):
            at, value = self.rows[i]
            out[k, at] = value
        return out


def linear_svm(x: Rows, which: np.ndarray, y: np.ndarray, rounds: int = 12, reg: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine on rows ``which``, by averaged subgradient steps. y: -1 or 1."""
    rng = np.random.default_rng(seed)
    w, mean = np.zeros(x.buckets + 1), np.zeros(x.buckets + 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    t = 0
    for r in range(rounds):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            rate = 20.0 / (1 + 0.02 * t)
            batch = x(which[at])
            wrong = y[at] * (batch @ w[:-1] + w[-1]) < 1
            g = weight[at[wrong]] * y[at[wrong]]
            w *= 1 - rate * reg
            w[:-1] += rate * (g @ batch[wrong]) / len(at)
            w[-1] += 0.1 * rate * g.sum() / len(at)
            if r >= rounds // 2:
                mean += w
    return mean


def _scaled(w: np.ndarray, x: Rows, which: np.ndarray) -> np.ndarray:
    """``w`` in units of the median absolute training margin, so that scores compare."""
    margins = [np.abs(x(at) @ w[:-1] + w[-1]) for at in np.array_split(which, max(1, len(which) // 256))]
    m = np.median(np.concatenate(margins))
    return w / m if m else w


class Model:
    """families: names; family_weights: one-versus-rest; pairs: family -> [(a, b, weights)] with a margin > 0 for a."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        x, lang = Rows(texts), np.array(langs)
        family = np.array([family_of(v) for v in langs])
        self.families = sorted(set(family))
        self.langs = {f: sorted(set(lang[family == f])) for f in self.families}

        def fit(at: np.ndarray, positive: np.ndarray) -> np.ndarray:
            which = np.flatnonzero(at)
            return _scaled(linear_svm(x, which, np.where(positive, 1.0, -1.0)), x, which).astype(np.float32)

        every = np.ones(len(lang), bool)
        if len(self.families) == 2:
            w = fit(every, family == self.families[0])
            self.family_weights = np.stack([w, -w])
        else:
            self.family_weights = np.stack([fit(every, family == f) if len(self.families) > 1 else np.zeros(x.buckets + 1, np.float32) for f in self.families])
        self.pairs = {f: [(a, b, fit(at := (lang == a) | (lang == b), lang[at] == a)) for a, b in combinations(self.langs[f], 2)] for f in self.families}

    def predict(self, text: bytes | None) -> tuple[str, float, str | None]:
        """Language, score from 0 to 1, family."""
        if not text or not has_letter(text):
            return "und", 0.0, None
        x = vector(text)
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        k = int(np.argmax(margins))
        family = self.families[k]
        sure = _logistic(margins[k]) if len(self.families) > 1 else 1.0
        votes = {v: [0, 0.0] for v in self.langs[family]}
        for a, b, w in self.pairs[family]:
            m = float(w[:-1] @ x + w[-1])
            for v, s in ((a, m), (b, -m)):
                votes[v][0] += s > 0
                votes[v][1] += s
        best = max(sorted(votes), key=lambda v: votes[v])
        inner = min((_logistic(m if best == a else -m) for a, b, w in self.pairs[family] if best in (a, b) for m in (float(w[:-1] @ x + w[-1]),)), default=1.0)
        return best, float(min(sure, inner)), family


def _logistic(m: float) -> float:
    return float(1 / (1 + np.exp(-3.0 * np.clip(m, -10, 10))))


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from the labelled rows of ``df``, a sample by hash of at most about ``sample_docs`` per language. None without labels."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    counts = {r["lang"]: r["n"] for r in df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return None
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000)) < max(1, min(1_000_000, 1_000_000 * sample_docs // n))))
    sample = [(r["text"].encode(), r["lang"]) for r in rows.where(chosen).select("text", "lang").toLocalIterator()]
    sample = sorted(s for s in sample if has_letter(s[0]))
    return Model([s[0] for s in sample], [s[1] for s in sample]) if sample else None


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, family."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = shared.value
        for part in parts:
            got = [m.predict(t) if m else ("und", 0.0, None) for t in as_bytes(part.column("text"))]
            yield {"doc_id": part.column("doc_id"), **{n: [g[k] for g in got] for k, n in enumerate(("lang_pred", "score", "family"))}}

    return map_slices(id_and_text(df, id_col, text_col), work, SCHEMA)
