"""Quality rules with risk-controlled thresholds.

Each rule scores a document in steps of a grid and would reject it from a cutoff on. A part of the labels
ranks the cutoffs of all rules on one ladder: step by step from the safest, a rung rejects where a rule's score is
reached by so much smaller a share of good than of bad documents. Labelled holdouts then choose a rung per stratum: rungs
are tested in order, and one is certified while the exact binomial (Clopper-Pearson) upper bound of the share of good
holdout documents that any of its rules rejects stays within ``alpha``; testing stops at the first that fails, so the
ladder costs nothing, and the confidence is divided by the strata (Bonferroni). With confidence 1 - ``delta`` no stratum
loses more than ``alpha`` of its good documents. Of the certified rungs the one is taken that rejects most bad
documents, a rejected good one counting as ``good_weight`` bad ones; where that helps nothing, nothing is rejected.

The bound needs independent holdouts. Labelled documents are therefore counted by text class, those whose smallest hash
of five words in a row agrees, which copies and most near copies do: a class is one observation, and one with a text in
another part is no holdout. The rule ``terms`` counts words that mark toxic documents; they are learned from a part of their
own, of at most about ``sample_docs`` labelled documents. All other statistics use all labelled rows.

Words are runs without ASCII white space over whole texts. Nulls: a null text has no words (and fails the
base rules), a null stratum is the stratum ''. A document without label only gets scores. Rows that repeat a
label are one label (the worst); rows that repeat a document are judged each; an empty table gives an empty
result; without labels no cutoff is certified and only the base rules reject. Other columns are ignored, or
pass through ``drop_rejected`` as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import near_dedup
from quern.llm.arrow import as_bytes, filter_slices, map_slices
from quern.staging import Stages

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Scores in steps of 0 to 1000: shares are per mille, the others are capped counts.
RULES = ("symbols", "dup_lines", "repeats", "long_words", "capitals", "terms")
GRID = 1000
FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in BASE), *(T.StructField(f"rule_{r}", T.LongType()) for r in RULES), T.StructField("base_failed", T.BooleanType())])
#: Share of good documents that the rules may reject per stratum, the chance that a guarantee fails, bad ones that outweigh a good one.
ALPHA, DELTA, GOOD_WEIGHT = 0.05, 0.05, 20.0
#: Shares of the labels that teach terms and rank cutoffs; rungs of the ladder, the ratio halving every ``HALVING``; bad documents that a cutoff must reject,
#: and that a stratum needs for a ladder of its own.
TERM_SHARE, LADDER_SHARE, RUNGS, HALVING, LEAST_BAD, OWN_LADDER = 0.2, 0.2, 49, 4, 3, 15
#: Labelled documents that train, at most about; the terms kept; least documents and precision of a term.
SAMPLE_DOCS, MAX_TERMS, TERM_DOCS, TERM_PRECISION = 20_000, 200, 4, 0.85
#: From so many words on, repeats are found with arrays of ranks instead of a set of windows.
LONG_WORDS = 50_000
_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) < LONG_WORDS:
        windows = list(zip(*(words[k:] for k in range(width)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen: dict[tuple, int] = {}
        first = [seen.setdefault(w, i) for i, w in enumerate(windows)]
        again = np.array([i != f for i, f in enumerate(first)])
        twice = np.array([*{f for i, f in enumerate(first) if i != f}, *np.flatnonzero(again).tolist()], dtype=np.int64)
    else:
        ids: dict[bytes, int] = {}
        base = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        rank, have = base, 1
        while have < width:  # ranks of windows of ``have`` words: pairs of ranks are exact in 64 bits
            step = min(have, width - have)
            tail = rank if step == have else base if step == 1 else None
            m = len(base) - have - step + 1
            rank = np.unique(rank[:m] * len(words) + tail[have : have + m], return_inverse=True)[1]
            have += step
        twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: bytes | None, terms: frozenset[bytes] = frozenset()) -> tuple[int, ...]:
    """The values of FEATURES after doc_id, for one text."""
    t = text or b""
    words = t.split()
    n = len(words)
    if not n:
        return (0,) * (len(BASE) + len(RULES)) + (True,)
    chars = len(t) if t.isascii() else len(t.decode())
    word_chars = chars - (len(t) - len(t.translate(None, _SPACES)))
    symbols = len(t) - len(t.translate(None, _SYMBOLS))
    lines = [x for x in t.split(b"\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = sum(map(terms.__contains__, t.lower().translate(_PLAIN).split())) if terms else 0
    per = lambda a, b: min(GRID, GRID * a // b)
    return (n, word_chars, symbols, dup, repeats, per(symbols, word_chars), per(dup, len(lines)), per(repeats, n), min(GRID, 10 * word_chars // n), per(capitals, word_chars), min(GRID, marks), n < 10 or 100 * repeats > 20 * n)


#: ASCII punctuation becomes white space before words are compared with marking terms.
_PLAIN = bytes(c if not (33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126) else 32 for c in range(256))


def text_class(text: bytes | None, words: near_dedup._Words) -> int:
    """The smallest hash of five words in a row; 0 without words."""
    shingles = near_dedup.shingle_set(text, words)
    return int(shingles[:1].view(np.int64)[0]) if len(shingles) else 0


def features(df: DataFrame, terms: frozenset[bytes] = frozenset(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = None, carry: bool = False) -> DataFrame:
    """FEATURES per row, ``stratum``, ``text_hash``, ``text_class``; with ``carry`` also all columns of ``df``, as in_0, in_1 and so on."""
    carried = [T.StructField(f"in_{k}", f.dataType) for k, f in enumerate(df.schema.fields)] if carry else []
    schema = T.StructType([*FEATURES.fields, T.StructField("stratum", T.StringType()), T.StructField("text_hash", T.LongType()), T.StructField("text_class", T.LongType()), *carried])
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    others = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(df.columns) if c != text_col] if carry else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), stratum.alias("stratum"), _hash(text_col).alias("text_hash"), *others)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names, memo = FEATURES.names[1:], near_dedup._Words()
        for part in parts:
            texts = as_bytes(part.column("text"))
            got = [measure(t, terms) for t in texts]
            same = {f.name: part.column(f.name if f.name in part.schema.names else "text") for f in (*schema.fields[len(FEATURES) : len(FEATURES) + 2], *carried)}
            yield {"doc_id": part.column("doc_id"), **same, **{n: [g[k] for g in got] for k, n in enumerate(names)}, "text_class": [text_class(t, memo) for t in texts]}

    return map_slices(rows, work, schema)


def _hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound at confidence 1 - delta for k of n."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = math.fsum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))
        low, high = (p, high) if tail > delta else (low, p)
    return high


def ladder(counts: dict[str, dict[int, tuple[int, int]]], rungs: int = RUNGS, halving: int = HALVING, least_bad: int = LEAST_BAD) -> list[dict[str, int]]:
    """rule -> score -> (good, bad training documents) gives the cutoffs of each rung, from the safest; a rung rejects all that those before it do."""
    out: list[dict[str, int]] = [{} for _ in range(rungs)]
    for rule, scores in counts.items():
        all_good, all_bad = sum(g for g, _ in scores.values()), sum(b for _, b in scores.values())
        good = bad = 0
        for cutoff in sorted((s for s in scores if s > 0), reverse=True):
            good, bad = good + scores[cutoff][0], bad + scores[cutoff][1]
            if bad >= least_bad:
                ratio = (good + 0.5) / (all_good + 1) * (all_bad + 1) / (bad + 0.5)
                # Rung k takes ratios up to 2 ** (-(rungs - 1 - k) / halving).
                for k in range(max(0, math.ceil(rungs - 1 + halving * math.log2(ratio) - 1e-9)), rungs):
                    out[k][rule] = cutoff
    return out


def choose_rung(counts: dict[int, tuple[int, int]], rungs: int, alpha: float, delta: float, good_weight: float = GOOD_WEIGHT) -> int | None:
    """The best certified rung, or None. ``counts``: first rejecting rung (``rungs``: none) -> (good, bad) holdouts."""
    n = sum(g for g, _ in counts.values())
    good = bad = 0
    best, chosen = 0.0, None
    for k in range(rungs):
        good, bad = good + counts.get(k, (0, 0))[0], bad + counts.get(k, (0, 0))[1]
        if upper_bound(good, n, delta) > alpha:
            break
        if bad - good_weight * good > best:
            best, chosen = bad - good_weight * good, k
    return chosen


def _labels(labels: DataFrame) -> DataFrame:
    """doc_id, bad: one row per labelled document."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad.cast("int")).alias("bad"), F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int")).alias("toxic"))


def learn_terms(texts: DataFrame, max_terms: int = MAX_TERMS, least_docs: int = TERM_DOCS, precision: float = TERM_PRECISION) -> frozenset[bytes]:
    """Words that mark toxic documents. ``texts``: text, toxic (0/1), of a bounded sample."""
    plain = F.translate(F.lower(F.col("text")), "".join(chr(c) for c in range(33, 127) if _PLAIN[c] == 32), " " * sum(1 for c in range(33, 127) if _PLAIN[c] == 32))
    words = texts.select("toxic", F.explode(F.array_distinct(F.split(plain, r"[ \t\n\r\x0B\f]+"))).alias("word")).where(F.col("word") != "")
    hits = F.sum("toxic")
    ranked = words.groupBy("word").agg(hits.alias("hits"), F.count(F.lit(1)).alias("docs")).where((F.col("hits") >= least_docs) & (F.col("hits") >= precision * F.col("docs"))).orderBy(F.desc("hits"), "word").limit(max_terms)
    return frozenset(r["word"].encode() for r in ranked.collect())


class Verdicts:
    """Fitted terms and cutoffs; ``cutoffs``: stratum -> rule -> least rejected score."""

    def __init__(self, terms: frozenset[bytes], cutoffs: dict[str, dict[str, int]]):
        self.terms, self.cutoffs = terms, cutoffs

    def keep(self, stratum: str, values: tuple[int, ...]) -> bool:
        """``values`` as ``measure`` gives them."""
        scores = values[len(BASE) : -1]
        limits = self.cutoffs.get(stratum, {})
        return not values[-1] and all(s < limits.get(r, GRID + 1) for r, s in zip(RULES, scores, strict=True))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA, sample_docs: int = SAMPLE_DOCS, carry: bool = False) -> tuple[Verdicts, DataFrame]:
    """Learn terms and certify cutoffs on the labelled documents; also the features of all documents, as a written table."""
    stages = Stages(df.sparkSession, "quality")
    known = _labels(labels)
    total = known.count()
    share = min(TERM_SHARE, sample_docs / max(total, 1))
    # 0: teaches terms, 1: ranks cutoffs, 2: holdout
    role = lambda h: (lambda x: F.when(x < int(1e6 * share), 0).when(x < int(1e6 * (share + LADDER_SHARE)), 1).otherwise(2))(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(1_000_000)))
    part = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"), _hash(text_col).alias("_hash")).where(role(F.col("_hash")) == 0)
    terms = learn_terms(stages.write(_one_of_a_class(part.join(known, F.col("_doc") == F.col("doc_id")).select("text", "toxic"))))
    scores = stages.write(features(df, terms, id_col, text_col, stratum_col, carry))
    rules = [f"rule_{r}" for r in RULES]
    labelled = scores.where("not base_failed").select("doc_id", "stratum", "text_class", "text_hash", *rules).join(known, "doc_id")
    classes = stages.write(labelled.groupBy("text_class").agg(F.max("bad").alias("bad"), F.min("stratum").alias("stratum"), F.min(role(F.col("text_hash"))).alias("role"), *(F.max(r).alias(r) for r in rules)))
    held = classes.where("role = 2")
    # A stratum with too few good documents can't be certified at any rung; the others are few.
    need = math.log(delta) / math.log1p(-alpha)
    strata = [r["stratum"] for r in held.where("bad = 0").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).collect()]
    steps = _ladders(classes.where("role = 1"), strata)
    counts: dict = {s: {} for s in strata}
    rows = [held.where(F.col("stratum") == s).select("stratum", "bad", _rung(steps[s]).alias("rung")) for s in strata]
    every = rows[0] if rows else held.limit(0).select("stratum", "bad", F.lit(0).alias("rung"))
    for r in rows[1:]:
        every = every.unionByName(r)
    for r in every.groupBy("stratum", "rung").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).collect():  # strata x rungs
        counts[r["stratum"]][r["rung"]] = (r["good"], r["bad"])
    chosen = {s: choose_rung(c, RUNGS, alpha, delta / max(1, len(strata))) for s, c in counts.items()}
    return Verdicts(terms, {s: {} if k is None else steps[s][k] for s, k in chosen.items()}), scores


def _ladders(training: DataFrame, strata: list[str]) -> dict[str, list[dict[str, int]]]:
    """The ladder of each stratum: its own where it has bad documents enough, else that of all strata."""
    each = training.select(F.when(F.col("stratum").isin(strata), F.col("stratum")).alias("stratum"), "bad", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"rule_{r}").alias("score")) for r in RULES))).alias("s"))
    own: dict = {s: {r: {} for r in RULES} for s in (*strata, None)}
    pooled: dict = {r: {} for r in RULES}
    for r in each.groupBy("stratum", "s.rule", "s.score").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).collect():  # strata x rules x grid
        own[r["stratum"]][r["rule"]][r["score"]] = (r["good"], r["bad"])
        g, b = pooled[r["rule"]].get(r["score"], (0, 0))
        pooled[r["rule"]][r["score"]] = (g + r["good"], b + r["bad"])
    enough = lambda s: sum(b for _, b in own[s][RULES[0]].values()) >= OWN_LADDER
    return {s: ladder(own[s] if enough(s) else pooled) for s in strata}


def _rung(steps: list[dict[str, int]]) -> Column:
    """The first rung that rejects a row, or their number."""
    out = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        if steps[k] != (steps[k - 1] if k else {}):
            out = F.when(_reaches(steps[k]), F.lit(k)).otherwise(out)
    return out


def _one_of_a_class(sample: DataFrame) -> DataFrame:
    """text, toxic: a text for each text class."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo = near_dedup._Words()
        for part in parts:
            yield {"text": part.column("text"), "toxic": part.column("toxic"), "text_class": [text_class(t, memo) for t in as_bytes(part.column("text"))]}

    classed = map_slices(sample, work, T.StructType([T.StructField("text", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("text_class", T.LongType())]))
    return classed.groupBy("text_class").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _reaches(cutoffs: dict[str, int]) -> Column:
    out = F.lit(False)
    for rule, cutoff in sorted(cutoffs.items()):
        out = out | (F.col(f"rule_{rule}") >= cutoff)
    return out


def judge(scores: DataFrame, verdicts: Verdicts) -> DataFrame:
    """FEATURES (of ``fit`` or ``features``) with ``kept``."""
    rejected = F.col("base_failed")
    for stratum, limits in sorted(verdicts.cutoffs.items()):
        rejected = rejected | ((F.col("stratum") == stratum) & _reaches(limits))
    return scores.withColumn("kept", ~rejected)


def keep_documents(df: DataFrame, labels: DataFrame, **params) -> tuple[DataFrame, Verdicts]:
    """``df`` without the documents that the base rules or the cutoffs fitted on them reject; all columns stay, and a text is measured once."""
    verdicts, scores = fit(df, labels, carry=True, **params)
    kept = judge(scores, verdicts).where("kept")
    return kept.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(df.columns))), verdicts


def drop_rejected(df: DataFrame, verdicts: Verdicts, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``df`` without the documents that the base rules or the cutoffs reject; all columns stay."""

    def keep(part: pa.RecordBatch) -> list[bool]:
        strata = part.column(stratum_col).to_pylist()
        return [verdicts.keep("" if s is None else str(s), measure(t, verdicts.terms)) for s, t in zip(strata, as_bytes(part.column(text_col)), strict=True)]

    return filter_slices(df, keep, text_col)
