"""Personal data: base spans against the stated patterns, and the weak supervision."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarryfield.llm import pii


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


BITS = ["a", "b.c", "@", "@x.org", ".", "-", "+", " ", "1", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "10.0.0.1", "0001", "\n", "é", "٣", "@@", "x@y", "..", "1.2.3", "%_"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_base(text)


@settings(max_examples=500, deadline=None)
@given(st.text("0123456789.@+- a", max_size=40))
def test_base_spans_of_noise(text):
    assert pii.base_spans(text) == brute_base(text)


MAIL_BITS = ["jane", "Reach", "example", "com", " ", " at ", " AT ", "(at)", "[AT]", "{At}", "at", ".", " dot ", " DOT ", "(dot)", "[Dot]", "{DOT}", "\n", "İ", "1"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(MAIL_BITS), max_size=12))
def test_every_obfuscated_mail_is_a_candidate(parts):
    text = "".join(parts)
    assert [(a, b) for a, k, b in pii.more_candidates(text) if k == 0] == [m.span() for m in pii._MORE["email"].finditer(text)]


def test_obfuscated_mail_notations():
    for text in ("Reach jane [AT] example.com", "jane at example[dot]com", "jane at example(dot)com", "jane at example.com", "JANE {AT} EXAMPLE {DOT} COM"):
        assert [k for _, k, _ in pii.more_candidates(text)] == [0], text


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000 + "@", "1" * 2_000_000 + ".1.1", "1." * 1_000_000, "@" * 300_000, "a@" * 500_000, "+1" + " " * 2_000_000):
        assert len(pii.base_spans(text)) < 300_000
        pii.more_candidates(text)


def test_estimate_finds_the_reliable_labelers():
    r = random.Random(0)
    counts = {}
    accuracy = (0.95, 0.9, 0.8, 0.55)
    for _ in range(20_000):
        y = r.random() < 0.4
        v = tuple((1 if (r.random() < a) == y else -1) if r.random() < 0.9 else 0 for a in accuracy)
        key = (0, False, v)
        counts[key] = counts.get(key, 0) + 1
    p, table = pii.estimate(counts)
    assert p[(0, False, (1, 1, 1, 1))] > 0.99 and p[(0, False, (-1, -1, -1, -1))] < 0.01
    right = [table[i, 1, 2] + table[i, 0, 0] for i in range(4)]
    assert right[0] > right[1] > right[2] > right[3]


def test_find(spark):
    filler = "lorem ipsum dolor sit amet "
    clean = [filler * 20 + "version 1.2.3, page 12-13, in 1999 at noon. Meet at the dot of ten." for _ in range(40)]
    planted = [filler + f"please contact jane.doe{i} (at) example (dot) com for details" for i in range(10)]
    planted += [filler + f"call (415) 555-01{i:02d}, or phone 212-555-77{i:02d} today" for i in range(10)]
    base = [filler + f"mail a{i}@b.example.com or +1 (555) 123-45{i:02d}, server 10.0.0.{i}" for i in range(30)]
    texts = clean + planted + base + [None, "", "x@y.z"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "q@w.de", "x"), (3, clean[3], "x")], "doc_id long, text string, base string").repartition(3)
    got = {g.doc_id: g for g in pii.find(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i].base] == brute_base(t or "")
        added = [(s.kind, (t or "")[s.start : s.end]) for s in got[i].added]
        if i < 40:
            assert not added
        elif i < 50:
            assert [k for k, _ in added] == [0] and "(at) example (dot) com" in added[0][1]
        elif i < 60:
            assert [k for k, _ in added] == [3, 3], added
    assert pii.find(df.limit(0)).count() == 0
