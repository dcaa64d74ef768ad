"""Personal data: patterns, and information-theoretic sanitisation of what surrounds them.

E-mail addresses, IP addresses, card and telephone numbers found by pattern are protected entities, as are secrets,
tokens that carry so much information of their own that they are no words. An entity belongs to classes: itself,
its kind, and what it shares with others (an e-mail's domain and user, a network, an issuer, an area). For a term t
and a class e, counts over whole documents give PMI(t; e) = log2(co * N / (df(t) * df(e))), and t discloses the share
PMI / IC(e) of the class's information IC(e) = log2(N / df(e)). Terms from ``generalise`` on are generalised, from
``remove`` on removed, wherever they stand in documents with an entity of the class. What chance may bring
is no evidence: the co-occurrences in texts of different origin must exceed what independent terms would show, by a
Chernoff bound at ``error`` over the number of pairs tested. Texts whose smallest five-word hash agrees are of one
origin, so copies and most near copies count once there. Base spans are never dropped.

A generalised term becomes its longest prefix that so many documents share that it discloses less than
``generalise``; where there is none it is removed.

Patterns are matched leftmost, without overlaps within a kind, in time linear in the text. Offsets are code
points, ends exclusive. Nulls: a null text is empty, a null id stays null. Rows equal in id and text are one
row of evidence and get the same spans each; ties in spans go by kind; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import as_bytes, map_slices
from quern.staging import Stages

KINDS = ("email", "ip", "card", "phone")
#: What the method adds to the kinds, by rank.
NAMES = (*KINDS, "secret", "term")
#: Disclosed share from which a term is generalised, and removed; chance that any independent term is marked; least origins.
GENERALISE, REMOVE, ERROR, MIN_ORIGINS = 0.8, 0.95, 0.01, 5
#: Bits from which a token of letters and digits is a secret: its length times the entropy of its characters.
SECRET_BITS = 64
#: Candidate terms up to which workers hold them to count documents; beyond, all terms are counted by a shuffle.
HELD_TERMS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_DIGITS = re.compile("[0-9]")
_LETTER = re.compile("[A-Za-z]")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType())])
_PLACE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(_PLACE))])
FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "secret")), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("secrets", T.ArrayType(_SPAN)), T.StructField("origin", T.LongType()), T.StructField("classes", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(_TERM))])


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            done = m.end()
            out.append((begin, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(p := p.lstrip("0")) < 4 and int(p or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        found += [(s, k, e) for k, f in ((1, ips), (2, cards), (3, phones)) for s, e in f(text)]
    return sorted(found)


def information(token: str) -> float:
    """Bits: the length times the entropy of the characters."""
    n = len(token)
    return -sum(c * math.log2(c / n) for c in Counter(token).values())


def secrets(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, rank, end) of tokens of letters and digits that are no words and touch none of ``spans`` (sorted)."""
    out, k, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach, k = max(reach, spans[k][2]), k + 1
        if reach <= m.start() and _DIGITS.search(m[0]) and _LETTER.search(m[0]) and information(m[0].rstrip("=")) >= SECRET_BITS:
            out.append((m.start(), len(KINDS), m.end()))
    return out


def classes_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The classes of all entities, as hashes."""
    names = set()
    for begin, rank, end in spans:
        kind, found = NAMES[rank], text[begin:end].lower()
        names |= {kind, f"{kind}={found}"}
        if kind == "email":
            user, _, domain = found.rpartition("@")
            names |= {f"domain={domain}", f"user={user}"}
        elif kind == "ip":
            names.add("net=" + ".".join(found.split(".")[:2]))
        elif kind in ("card", "phone"):
            digits = "".join(filter(str.isdigit, found))
            names.add(f"{kind}:{digits[: 6 if kind == 'card' else 4]}")
    return sorted(_signed(xxhash.xxh64(n).intdigest()) for n in names)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """The places of all words that touch no span (sorted), in time linear in both."""
    out: dict[str, list[tuple[int, int]]] = {}
    k = reach = 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach, k = max(reach, spans[k][2]), k + 1
        if reach <= m.start():
            out.setdefault(m[0].lower(), []).append(m.span())
    return out


def origin_of(text: str) -> int:
    """The smallest hash of five words in a row, the same for most near copies."""
    words = text.lower().split()
    return _signed(min((xxhash.xxh64(" ".join(words[k : k + 5])).intdigest() for k in range(max(1, len(words) - 4))), default=0))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.xxhash64(doc, text).alias("row"), doc.alias("doc_id"), text.alias("text"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND per row: base spans and what surrounds them."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        spans = lambda found: [[{"start": s, "rank": r, "end": e} for s, r, e in x] for x in found]
        for part in parts:
            texts = [t.decode() for t in as_bytes(part.column("text"))]
            base = list(map(base_spans, texts))
            added = [secrets(t, b) for t, b in zip(texts, base, strict=True)]
            every = [sorted(b + a) for b, a in zip(base, added, strict=True)]
            counts = [Counter(r for _, r, _ in x) for x in every]
            near = [terms_of(t, x) if x else {} for t, x in zip(texts, every, strict=True)]
            yield {
                "row": part.column("row"),
                "doc_id": part.column("doc_id"),
                **{f"n_{k}": [c[r] for c in counts] for r, k in enumerate((*KINDS, "secret"))},
                "base": spans(base),
                "secrets": spans(added),
                "origin": [origin_of(t) if x else 0 for t, x in zip(texts, every, strict=True)],
                "classes": [classes_of(t, x) for t, x in zip(texts, every, strict=True)],
                "terms": [[{"term": t, "places": [{"start": a, "end": b} for a, b in places]} for t, places in n.items()] for n in near],
            }

    return map_slices(_rows(df, id_col, text_col), work, FOUND)


def _documents_with(rows: DataFrame, terms: DataFrame, prefixes: bool = False) -> DataFrame:
    """term, documents: in how many rows each of ``terms`` occurs, as a word or (``prefixes``) as the beginning of one."""
    held = frozenset(r["term"] for r in terms.limit(HELD_TERMS + 1).collect())  # bounded; beyond the bound all are counted
    only = held if len(held) <= HELD_TERMS else None

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter = Counter()
        for part in parts:
            for t in as_bytes(part.column("text")):
                words = set(_WORD.findall(t.decode().lower()))
                if prefixes:
                    words = {w[:k] for w in words for k in range(1, len(w) + 1)}
                counts.update(words if only is None else words & only)
            if len(counts) > HELD_TERMS:
                yield {"term": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"term": list(counts), "n": list(counts.values())}

    seen = map_slices(rows.select("text"), work, T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]))
    counted = seen.groupBy("term").agg(F.sum("n").alias("documents"))
    return counted if only is not None else counted.join(terms, "term", "left_semi")


def disclosing_terms(found: DataFrame, rows: DataFrame, stages: Stages, generalise: float = GENERALISE, error: float = ERROR, min_origins: int = MIN_ORIGINS) -> DataFrame:
    """class, term, share, with_class: what terms disclose of classes, from ``generalise`` on. ``found``: a written FOUND.

    Terms that too few rows with entities hold, or so many others that no class can be disclosed, are left out before
    pairs of classes and terms are counted; neither can reach the thresholds.
    """
    n = float(max(found.count(), 1))
    some = found.where(F.size("classes") > 0)
    classes = stages.write(some.select("origin", F.explode("classes").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("with_class"), F.count_distinct("origin").alias("origins")).where(F.col("origins") >= min_origins).select("class", "with_class"))
    words = some.select("row", F.explode("terms.term").alias("term"))
    often = stages.write(words.groupBy("term").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= min_origins))
    least = ((classes.agg(F.min("with_class")).first()[0] or 1) / n) ** (1 - generalise)
    # A term discloses at most held / documents of its rows to a class, so classes above this bar can't reach ``generalise``.
    bar = F.lit(n) * F.pow(F.col("held") / F.col("documents"), F.lit(1 / (1 - generalise))) * F.lit(1 + 1e-9) if generalise < 1 else F.when(F.col("held") >= F.col("documents"), F.lit(n)).otherwise(F.lit(0.0))
    of_term = stages.write(_documents_with(rows, often.select("term")).join(often, "term").where(F.col("held") >= F.lit(least) * F.col("documents")).select("term", "documents", bar.alias("bar")))
    of_row = some.select("row", "origin", F.explode("classes").alias("class")).join(classes, "class").distinct()
    seen = words.join(of_term.select("term", "bar"), "term").join(of_row, "row").where(F.col("with_class") <= F.col("bar"))
    together = stages.write(seen.groupBy("class", "term").agg(F.count(F.lit(1)).alias("co"), F.count_distinct("origin").alias("origins")).where(F.col("origins") >= min_origins))
    tests = max(together.count(), 1)
    counted = together.join(of_term.drop("bar"), "term").join(classes, "class")
    bits = F.log2(F.lit(n) / F.col("with_class"))
    pmi = F.log2(F.col("co") * F.lit(n) / (F.col("documents") * F.col("with_class")))
    expected = F.col("documents") * F.col("with_class") / F.lit(n)
    chance = F.col("origins") - expected - F.col("origins") * F.ln(F.col("origins") / expected)
    proven = (F.col("origins") > expected) & (chance <= math.log(error / tests))
    return counted.where((bits > 0) & proven).select("class", "term", (pmi / bits).alias("share"), "with_class").where(F.col("share") >= generalise)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, error: float = ERROR, min_origins: int = MIN_ORIGINS) -> DataFrame:
    """row, doc_id, the counts of all kinds, base and secrets (spans), terms (start, end, removed, term, need) per row.

    ``need``: the documents that a generalisation of the term must exceed.
    """
    stages = Stages(df.sparkSession, "pii")
    found = stages.write(find(df, id_col, text_col))
    n = float(max(found.count(), 1))
    disclosing = stages.write(disclosing_terms(found, _rows(df, id_col, text_col), stages, generalise, error, min_origins))
    need = F.lit(n) * F.pow(F.col("with_class") / F.lit(n), F.lit(generalise))
    marked = found.where(F.size("classes") > 0).select("row", "classes", F.explode("terms").alias("t")).select("row", "classes", "t.term", "t.places").join(disclosing.select("class", "term", "share", need.alias("need")), "term")
    hits = marked.where(F.array_contains("classes", F.col("class"))).select("row", "term", "share", "need", F.explode("places").alias("p")).groupBy("row", "p", "term").agg(F.max("share").alias("share"), F.max("need").alias("need"))
    terms = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("p.start", "p.end", (F.col("share") >= remove).alias("removed"), "term", "need"))).alias("terms"))
    return found.drop("origin", "classes", "terms").join(terms, "row", "left")


def digest(detected: DataFrame) -> DataFrame:
    """doc_id, the counts, base_sha256 and spans (``kind:start:end``, comma-joined) of ``detect``, and the number of all spans."""
    named = lambda kind: lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))
    of_rank = F.array(*(F.lit(k) for k in NAMES))
    text = lambda spans: F.array_join(F.transform(spans, named(lambda s: F.get(of_rank, s["rank"]))), ",")
    none = F.array().cast(T.ArrayType(_SPAN))
    terms = F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(NAMES.index("term")).alias("rank"), s["end"].alias("end"))), none)
    every = F.array_sort(F.concat("base", "secrets", terms))
    counts = [f"n_{k}" for k in (*KINDS, "secret")]
    return detected.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"), F.size(terms).cast("long").alias("n_terms"), F.size(every).cast("long").alias("n_spans"))


def _prefixes(detected: DataFrame, rows: DataFrame) -> DataFrame:
    """term, put: the longest prefix of each generalised term that enough documents share, and a star; else empty."""
    wanted = detected.select(F.explode("terms").alias("t")).where("not t.removed").groupBy("t.term").agg(F.max("t.need").alias("need"))
    each = wanted.select("term", "need", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.substring("term", F.lit(1), k))).alias("prefix"))
    counts = _documents_with(rows, each.select(F.col("prefix").alias("term")).distinct(), prefixes=True).select(F.col("term").alias("prefix"), "documents")
    fit = each.join(counts, "prefix").where((F.col("documents") > F.col("need")) & (F.col("prefix") != F.col("term"))).groupBy("term").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix")).alias("p"))
    return wanted.select("term").join(fit, "term", "left").select("term", F.coalesce(F.concat("p.prefix", F.lit("*")), F.lit("")).alias("put"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """doc_id, text with entities replaced by ``[EMAIL]`` and so on, disclosing terms by a prefix and a star, or removed."""
    rows = _rows(df, id_col, text_col)
    detected = Stages(df.sparkSession, "sanitise").write(detect(df, id_col, text_col, **params).dropDuplicates(["row"]))
    put = _prefixes(detected, rows)
    shown = detected.select("row", F.explode("terms").alias("t")).join(put, F.col("t.term") == put["term"], "left").groupBy("row").agg(F.collect_list(F.struct(F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.when(F.col("t.removed"), F.lit("")).otherwise(F.col("put")).alias("put"))).alias("puts"))
    joined = rows.join(detected.select("row", F.concat("base", "secrets").alias("base")), "row").join(shown, "row", "left").select("doc_id", "text", "base", "puts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, base, puts in zip(*(b.column(c).to_pylist() for c in ("text", "base", "puts")), strict=True):
                spans = [(s["start"], s["end"], f"[{NAMES[s['rank']].upper()}]") for s in base or []] + [(t["start"], t["end"], t["put"]) for t in puts or []]
                parts, at = [], 0
                for start, end, new in sorted(spans):
                    if end <= at:
                        continue
                    if start >= at:
                        parts += [text[at:start], new]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return joined.mapInArrow(run, "doc_id long, text string")
