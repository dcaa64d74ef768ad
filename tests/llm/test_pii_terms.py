"""Personal data: fuzzed patterns, disclosed shares by brute force, long texts, generalisation."""

import math
import random
import re
import time

import pytest

from quern.llm import pii
from quern.staging import Stages


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(twice)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters,size", [("ab@@..- é", 16), ("0129..- ", 24), ("04 -", 30), ("+1(5). -0", 24)])
def test_base_spans_equal_the_patterns(letters, size):
    r = random.Random(size)
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(size)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_secrets_carry_information_and_touch_no_other_span():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    t = f'token = "{key}" {"ab1" * 3}{"a" * 40} {"x" * 30}1 antidisestablishmentarianism {key}@mail.example.com'
    assert [t[s:e] for s, _, e in pii.secrets(t, pii.base_spans(t))] == [key]


def test_many_spans_in_one_text_take_little_time():
    t = "word me@there.org 10.0.0.1 " * 10_000
    began = time.time()
    spans = pii.base_spans(t)
    pii.secrets(t, spans), pii.classes_of(t, spans), pii.origin_of(t)
    terms = pii.terms_of(t, spans)
    assert len(spans) == 20_000 and list(terms) == ["word"] and time.time() - began < 2


def test_shares_equal_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioumnrst") for _ in range(3))
    texts = [" ".join(word() for _ in range(30)) + (" qux" if i % 9 == 0 else "") for i in range(200)]
    texts += [f"{' '.join(word() for _ in range(20))} zorg me{i}@x.org {' '.join(word() for _ in range(20))} qux" for i in range(12)]
    texts += [texts[-1]] * 5 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stages = Stages(spark, "test")
    found = stages.write(pii.find(df))
    got = {(x["class"], x["term"]): x["share"] for x in pii.disclosing_terms(found, pii._rows(df, "doc_id", "text"), stages, generalise=0.3).collect()}
    words = [set(re.findall(r"[^\W\d_]{2,}", (t or "").lower())) for t in texts]
    own = [set(pii.classes_of(t or "", pii.base_spans(t or ""))) for t in texts]
    has = lambda c: [i for i, o in enumerate(own) if c in o]
    email = pii._signed(__import__("xxhash").xxh64("email").intdigest())
    n, df_e = len(texts), len(has(email))
    for term in ("zorg", "qux"):
        df_t, co = sum(term in w for w in words), sum(term in words[i] for i in has(email))
        assert got[email, term] == pytest.approx(math.log2(co * n / (df_t * df_e)) / math.log2(n / df_e))
    assert {t for _, t in got} == {"zorg", "qux"}


def test_generalised_terms_become_common_prefixes(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioumnrst") for _ in range(6))
    texts = [" ".join(word() for _ in range(12)) + " zorba" for i in range(150)]
    texts += [f"{' '.join(word() for _ in range(9))} zorbanum me{i}@x.org" for i in range(30)]
    texts += [" ".join(word() for _ in range(12)) + " zorbanum" for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(df, remove=2.0, generalise=0.7).collect()}
    assert all(" zorba* [EMAIL]" in clean[i] for i in range(150, 180))
    assert all(clean[i] == texts[i] for i in [*range(150), *range(180, 188)])
