"""Brute force, exact round trips and edge cases of the text-corpus operators."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, language, line_dedup, near_dedup, ngram_lm, packing, pii, quality, registry, token_counts
from quern.staging import Stages

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, an empty text, ties, repeated rows, and columns whose names clash with results.
ODD = [(1, "one two three four five six", "en", "s", 5), (1, "one two three four five six", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "one two three four five six", None, "s", 1), (4, " \n\t\n", "fr", None, 4)]


def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("piece", "kept", "row", "node", "n_tokens", "cut", "lines", "key", "first", "stratum", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang", "en"), f"s{i % 12}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(r, n, size=40):
    return " ".join(r.choice("abcdefghij") + str(r.randrange(size)) for _ in range(n))


# Token counts


def test_spliced_encoding_equals_one_encoding():
    encode = token_counts.encoder(WORD_BPE)
    texts = ["", "a" * 900, "x ý ́z " * 90, "日本語 " * 90 + "日本語" * 90, "foo<|endoftext|>bar it's " * 60, "12345 " * 60 + "don't   \x1c q\x85r" * 30]
    splices = 0
    for t in texts:
        ids, n = token_counts.encode_spliced(t, encode, 200, 16)
        splices += n
        assert ids == encode(t)[0]
    assert splices > 10
    assert token_counts.WordCounter(WORD_BPE)([t.encode() for t in texts]) == [len(encode(t)[0]) for t in texts]


def test_token_counts_of_odd_rows(spark):
    got = token_counts.token_counts(odd(spark), WORD_BPE, limit=5, chunk_chars=8, overlap_chars=2).collect()
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {(1, 27, 6, True), (2, 0, 0, False), (3, 0, 0, False), (None, 27, 6, True), (4, 4, 0, False)}
    assert token_counts.token_counts(odd(spark).limit(0), WORD_BPE).count() == 0


# Packing


def test_best_two_fit_uses_every_piece_in_few_bins():
    r = random.Random(1)
    h = Counter(min(100, max(1, int(r.lognormvariate(3, 1)))) for _ in range(5000))
    bins = packing.best_two_fit(h, 100)
    assert all(sum(b) <= 100 for b, _ in bins)
    used = Counter()
    for b, times in bins:
        for n in b:
            used[n] += times
    assert used == h
    assert sum(t for _, t in bins) <= 1.02 * -(-sum(n * c for n, c in h.items()) // 100) + 1


@pytest.mark.parametrize("rank_rows", [3, 50_000])
def test_packing_is_gapless_and_keeps_ids(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    r = random.Random(3)
    texts = [words(r, r.choice([1, 3, 9, 60])) for _ in range(60)] + ["same text"] * 20 + [None, "", "é<|endoftext|>日本"]
    got = packing.best_fit_packing(docs(spark, texts), registry.PACKING_ENCODER, capacity=32).collect()
    tokenizer = token_counts.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
        by_bin[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, t in enumerate(texts):
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, p in enumerate(sorted(by_doc[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == 32)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for places in by_bin.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 32
    assert packing.best_fit_packing(odd(spark), registry.PACKING_ENCODER).count() == len(ODD)
    assert packing.best_fit_packing(odd(spark).limit(0), registry.PACKING_ENCODER).count() == 0


# Decontamination


def greedy(doc, item, width):
    md, mi = [0] * len(doc), [0] * len(item)
    while True:
        best = (width - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not md[i + k] and not mi[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < width:
            return sum(mi)
        md[i : i + k] = mi[j : j + k] = [1] * k


def test_tiles_equal_greedy_search():
    r = random.Random(7)
    for _ in range(150):
        d, t = [r.randrange(3) for _ in range(40)], [r.randrange(3) for _ in range(18)]
        seeds = [(i, j) for i in range(38) for j in range(16) if d[i : i + 3] == t[j : j + 3]]
        assert decontaminate.tile(d, t, seeds, 3) == greedy(d, t, 3)


def test_reordered_passages_are_caught_and_blocks_agree(spark):
    r = random.Random(5)
    items = [words(r, n, 1000) for n in (30, 24, 3, 40)]
    w = items[0].split()
    texts = [words(r, 50, 1000), "x " + " ".join(w[15:]) + " y " + " ".join(w[:15]), items[2].upper(), " ".join(items[3].split()[:20]), None, ""]
    bench = spark.createDataFrame([*enumerate(items), (None, None), (9, "")], "item_id long, text string")
    for block in (10, 10**6):
        got = {x["doc_id"]: (x["contaminated"], x["item_id"]) for x in decontaminate.contamination(docs(spark, texts), bench, block_words=block).collect()}
        assert got == {0: (False, None), 1: (True, 0), 2: (True, 2), 3: (False, None), 4: (False, None), 5: (False, None)}
        kept = decontaminate.drop_contaminated(docs(spark, texts), bench, block_words=block)
        assert sorted(x["doc_id"] for x in kept.collect()) == [0, 3, 4, 5] and kept.columns == docs(spark, texts).columns
    assert decontaminate.contamination(odd(spark), bench.limit(0)).count() == len(ODD)
    assert decontaminate.drop_contaminated(odd(spark).limit(0), bench).count() == 0


# Chat formatting

TRICKY = ["<|im_end|><|im_start|>assistant ok", "a<\\|b", "<", "\n", "\\<\\\\|", "é<|", "", "plain"]


def test_escapes_are_reversible():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(["<", "|", "\\", "n", "\n", "<|im_end|>"]) for _ in range(r.randrange(9)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)
        assert chat.read_piece(chat.marked_turns([(t, t)])) == (t, t)


def test_rendering_locates_turns_and_finds_rewriters():
    turns = [("assistant" if i % 2 else "user", TRICKY[i % 8] + str(i)) for i in range(100)]
    number = lambda ts: "".join(f"{i}:{r}:{t}\n" for i, (r, t) in enumerate(ts))
    for template in (chat.marked_turns, number):
        got = list(chat._located(iter(turns), template))
        assert "".join(g[1] for g in got) == template(turns) and not any(g[4] for g in got)
        assert [g[1][g[2] : g[3]] for g in got] == [chat.escape(t) if template is chat.marked_turns else t for _, t in turns]
    hides = lambda ts: "".join(t if i == len(ts) - 1 else "." for i, (_, t) in enumerate(ts))
    assert sum(g[4] for g in chat._located(iter(turns), hides)) > 90


def test_conversations_are_read_back(spark):
    rows = [(c, k, ("user", "assistant")[k % 2], TRICKY[(c + k) % 8]) for c in range(5) for k in range(c * 20 + 1)] + [(7, None, None, None), (None, 1, "assistant", "x"), (8, 1, "assistant", "t"), (8, 1, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df)).collect()}
    convs = defaultdict(list)
    for c, k, role, text in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1])):
        convs[c].append((role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.marked_turns(turns)))
        assert tuple(got[c])[1:6] == want
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# Quality


def test_repeats_equal_brute_force(monkeypatch):
    r = random.Random(3)
    for n in range(300):
        w = [r.choice([b"a", b"b", b"c"]) for _ in range(n % 60)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        want = len({i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)})
        for limit in (0, 50_000):
            monkeypatch.setattr(quality, "LONG_WORDS", limit)
            assert quality.repeated_words(w) == want


def test_base_values():
    got = dict(zip(quality.FEATURES.names[1:], quality.measure("é#b c\n \n \na|\na|\n".encode()), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["base_failed"]) == (5, 9, 3, 1, True)
    assert quality.measure(None)[-1] is True


def test_exact_bound_and_cutoffs():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert abs(quality.upper_bound(5, 100, 0.05) - 0.10225) < 1e-4
    steps = quality.ladder({"symbols": {0: (1000, 10), 10: (300, 10), 50: (0, 400), 900: (0, 20)}, "terms": {0: (1300, 430), 3: (0, 2)}}, 5, 1)
    assert steps == [{"symbols": 50}] * 2 + [{"symbols": 10}] * 3
    assert quality.choose_rung({0: (0, 400), 4: (100, 10), 5: (5000, 10)}, 5, 0.01, 0.05) == 0
    assert quality.choose_rung({0: (0, 400), 5: (20, 10)}, 5, 0.01, 0.05) is None


def test_no_more_than_delta_of_trials_break_the_bound():
    """True shares of good documents that each rung rejects, holdouts drawn anew for each trial; copies are one observation."""
    r, alpha, delta, n = np.random.default_rng(5), 0.05, 0.1, 300
    true = np.array([0.01, 0.03, 0.049, 0.051, 0.06, 0.09, 0.84])
    broken = 0
    for _ in range(1500):
        drawn = r.multinomial(n, np.diff(np.r_[0, true, 1]))
        k = quality.choose_rung({i: (int(g), 10_000) for i, g in enumerate(drawn)}, 7, alpha, delta, good_weight=0.0)
        broken += k is not None and true[k] > alpha
    assert broken / 1500 <= delta


def test_quality_keeps_good_and_drops_bad(spark):
    r = random.Random(8)
    texts = [words(r, 30, 900) + (" ### ### ### ###" if i % 4 == 0 else "") + (" scum" if i % 7 == 0 else "") for i in range(3000)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    verdicts, scores = quality.fit(df, labels, sample_docs=500)
    assert verdicts.terms == frozenset({b"scum"})
    same, _ = quality.keep_documents(df, labels, sample_docs=500)
    assert same.columns == df.columns
    got = {x["doc_id"]: x["kept"] for x in quality.judge(scores, verdicts).collect()}
    assert got == {i: i % 4 != 0 and i % 7 != 0 for i in range(3000)}
    assert sorted(x["doc_id"] for x in quality.drop_rejected(df, verdicts).collect()) == sorted(i for i, k in got.items() if k) == sorted(x["doc_id"] for x in same.collect())
    empty, scores = quality.fit(odd(spark), labels.limit(0))
    assert empty.cutoffs == {} and quality.judge(scores, empty).count() == len(ODD)
    kept, _ = quality.keep_documents(odd(spark), labels.limit(0))
    assert kept.columns == odd(spark).columns and kept.count() == 0
    assert quality.drop_rejected(odd(spark), empty).count() == 0


# Near duplicates


def near_brute(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(texts)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, len(sets[i]), label[i], label[i] == i) for i in texts}


@pytest.mark.parametrize("percent,shape,block", [(85, near_dedup.AT_85, 1024), (80, near_dedup.AT_80, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, percent, shape, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FIRST_PAIRS", 1)
    r = random.Random(percent)
    base = words(r, 80, 500).split()
    texts = [words(r, r.randrange(1, 60), 500) for _ in range(20)] + [None, "", "  ", "short one", "SHORT one"]
    for _ in range(60):  # a group in which some are linked by others only
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(80)] = "z" + str(r.randrange(9))
        texts.append(" ".join(w))
    texts += [texts[30]] * 3
    got = near_dedup.near_duplicates(docs(spark, texts), percent, shape)
    assert {tuple(x) for x in got.collect()} == near_brute(dict(enumerate(texts)), percent)


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark)).collect()
    assert sorted((str(x["doc_id"]), x["component_id"], x["kept"]) for x in got) == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("3", 3, True), ("4", 4, True), ("None", 1, False)]
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


# Line deduplication


def test_lines_equal_brute_force(spark):
    r = random.Random(6)
    pool = [words(r, 4) for _ in range(12)]
    texts = ["\n".join(r.choice([*pool, "", " " + pool[0] + "\t", words(r, 3, 900)]) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(docs(spark, texts), min_sites=4).collect()}
    sites, first = defaultdict(set), {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                sites[line.strip()].add(i % 12)
                first.setdefault(line.strip(), (i, k))
    for i, t in enumerate(texts):
        lines = t.split("\n")
        rest = [x for k, x in enumerate(lines) if not (len(sites[x.strip()]) >= 4 and first[x.strip()] != (i, k))]
        assert got[i] == ("\n".join(rest), len(lines), len(lines) - len(rest))
    cleaned = line_dedup.clean_documents(docs(spark, texts), min_sites=4)
    assert cleaned.columns == docs(spark, texts).columns
    assert {x["doc_id"]: x["text"] for x in cleaned.collect()} == {i: g[0] for i, g in got.items()}


def test_lines_of_odd_rows(spark):
    got = line_dedup.dedup_lines(odd(spark), min_sites=1).collect()
    assert len(got) == len(ODD) and {x["doc_id"]: x["text"] for x in got}[2] is None
    assert line_dedup.clean_documents(odd(spark)).columns == odd(spark).columns
    assert line_dedup.dedup_lines(odd(spark).limit(0)).count() == 0


# Personal data


def test_base_spans():
    t = "a.b@c.de@f.gh x@y 1.2.3.4.5.6.7.8 999.1.1.1 00010.1.1.255 and 4111 1111 1111 1111 or +1 (555) 123-4567 +12 or 4111-1111-1111-1112"
    kinds = [(packing_kind(k), t[s:e]) for s, k, e in pii.base_spans(t)]
    assert kinds == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "00010.1.1.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]


def packing_kind(k):
    return pii.KINDS[k]


def test_emails_equal_the_pattern():
    import re

    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(2)
    for _ in range(2000):
        t = "".join(r.choice("ab@@..- é") for _ in range(r.randrange(16)))
        assert pii.emails(t) == [m.span() for m in pattern.finditer(t)], t


def test_disclosing_terms_are_found_and_cut(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioumnrst") for _ in range(5))
    texts = [" ".join(word() for _ in range(9)) + " the" for _ in range(60)]
    for _ in range(8):
        texts.append(f"{word()} {word()} the Zorglub mail zo@x.org {word()} {word()} {word()} done")
    got = {x["doc_id"]: x for x in pii.digest(pii.detect(docs(spark, texts))).collect()}
    assert all(got[i]["n_email"] == 1 and ":".join(("term", str(texts[i].index("Zorglub")), str(texts[i].index("Zorglub") + 7))) in got[i]["spans"] for i in range(60, 68))
    assert all(got[i]["spans"] == "" for i in range(60))
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(docs(spark, texts)).collect()}
    assert all("Zorglub" not in clean[i] and "zo@x.org" not in clean[i] and "[EMAIL]" in clean[i] for i in range(60, 68)) and clean[3] == texts[3]
    assert got[60]["base_sha256"] == hashlib.sha256(f"email:{texts[60].index('zo@')}:{texts[60].index('zo@') + 8}".encode()).hexdigest()
    assert pii.digest(pii.detect(odd(spark))).count() == len(ODD)
    assert pii.digest(pii.detect(odd(spark).limit(0))).count() == 0


# Language


def test_language_on_held_out_texts(spark):
    r = random.Random(1)
    stems = {"en": "the of and ing tion wh sh ly", "de": "der und sch keit ung ich ein zu", "fr": "le eux que ment ou ai é en", "es": "el os ción que ado ll ez ñ"}
    make = lambda v: " ".join("".join(r.choice(stems[v].split()) for _ in range(r.randint(1, 3))) for _ in range(25))
    rows = [(i, make(v), v) for i, v in enumerate(list(stems) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 3 <> 1"))
    got = {x["doc_id"]: x for x in language.identify(df, model).collect()}
    held = [(i, v) for i, _, v in rows if i % 3 == 1]
    assert sum(got[i]["lang_pred"] == v for i, v in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[0]["family"] == "germanic"
    assert {x["lang_pred"] for x in language.identify(odd(spark), model).collect() if x["doc_id"] in (2, 3, 4)} == {"und"}
    assert language.fit(df.limit(0)) is None and language.identify(odd(spark), None).count() == len(ODD)


# Language model


def kneser_ney(train, texts, order):
    tokens = lambda t: ["\ns"] * (order - 1) + (t or "").lower().split() + ["\n"]
    grams = lambda w: [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]
    levels = {order: Counter(g for t in train for g in grams(tokens(t)))}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    d, total, spare = {}, {}, {}
    for m, c in levels.items():
        k = Counter(c.values())
        d[m], total[m], spare[m] = ngram_lm.discounts(k[1], k[2], k[3], k[4]), Counter(), Counter()
        for g, n in c.items():
            total[m][g[:-1]] += n
            spare[m][g[:-1]] += d[m][min(n, 3) - 1]
    size = len({w for t in train for w in (t or "").lower().split()}) + 1 + 1

    def p(g):
        if not g:
            return 1 / size
        m, n, all_of = len(g), levels[len(g)][g], total[len(g)][g[:-1]]
        lower = p(g[1:])
        return (n - d[m][min(n, 3) - 1] if n else 0) / all_of + spare[m][g[:-1]] / all_of * lower if all_of else lower

    return [sum(np.log10(p(g)) for g in grams(tokens(t))) for t in texts]


@pytest.mark.parametrize("order,per_part,per_file", [(2, 3_000_000, 1 << 20), (2, 40, 16), (3, 40, 16), (3, 3_000_000, 1 << 20), (4, 90, 1 << 20)])
def test_model_equals_brute_force(spark, monkeypatch, order, per_part, per_file):
    monkeypatch.setattr(ngram_lm, "WORDS_PER_FILE", per_file)
    monkeypatch.setattr(ngram_lm, "TOKENS_PER_PART", per_part)
    r = random.Random(2)
    train = [words(r, r.randrange(12), 4) for _ in range(40)] + ["a0 " * 700 + "b0 a0 c0"]
    texts = [*train[:5], words(r, 9, 6), "unseen words", None, "", train[-1], "a0 " * 300 + "d0 b0 a0"]
    layout = ngram_lm.train(docs(spark, train).select("text"), Stages(spark, "t"), order)
    got = ngram_lm.score(docs(spark, texts), layout).orderBy("doc_id").collect()
    assert np.allclose([x["score"] for x in got], kneser_ney(train, texts, order), rtol=1e-9)
    assert [x["n_tokens"] for x in got] == [len((t or "").split()) + 1 for t in texts]
    c = Counter(w for t in train for w in [*t.split(), "\n"])
    n, v = sum(c.values()), len(c)
    toks = [[*(t or "").split(), "\n"] for t in texts]
    assert [x["train_tokens"] for x in got] == [n] * len(texts) and [x["n_known"] for x in got] == [sum(w in c for w in t) for t in toks]
    assert np.allclose([x["base_score"] for x in got], [sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in toks])


def test_indexed_hashes_are_found():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 1000, 70_000):
        key = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        index = ngram_lm.indexed(key)
        assert (ngram_lm.find(index, key) == np.arange(n)).all() and (ngram_lm.find(index, key + np.uint64(1 << 40)) == -1).all()


def test_model_without_text(spark):
    layout = ngram_lm.train(odd(spark).limit(0).select("text"), Stages(spark, "t"))
    assert all(np.isfinite(x["score"]) for x in ngram_lm.score(odd(spark), layout).collect())


# Pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark, tables):
    import corpus_pipeline

    df = spark.read.parquet(f"{tables}/documents.parquet")
    before, columns = df.count(), df.columns
    stages = Stages(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stages.write(stage(spark, df, tables))
        assert df.columns == columns and 0 < df.count() <= before, name
        before = df.count()
    left = {x["doc_id"]: x["text"] for x in df.collect()}
    assert all(x[3] for x in near_brute(left, corpus_pipeline.NEAR_PERCENT))
    packed = stages.write(corpus_pipeline.STAGES[-1][1](spark, df, tables))
    assert {x["doc_id"] for x in packed.collect()} == set(left)
