"""Native operators against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarryfield.llm import chat, line_dedup, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plan_of(df):
    return df._jdf.queryExecution().toString()


# quality


def brute_stats(text):
    t = text or ""
    w = WORD.findall(t)
    tri = list(zip(w, w[1:], w[2:]))
    c, cover, seen, dup = collections.Counter(tri), set(), set(), 0
    for i, x in enumerate(tri):
        if c[x] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover), len(lines)


TEXTS = [None, "", " \t\n\x0b\x0c\r", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b a b a b q", "é 日本 🙂 # $\n\nq\nq\n q\nq ", "one\xa0two three", "a b c", "l1\r\nl1\r\nl1", "# * $ % & | < >", "w " * 400]


def corpus():
    r = random.Random(4)
    words = ["the", "of", "and", *(f"w{i}" for i in range(40))]
    return TEXTS + [r.choice([" ", "\n", "  ", "\t"]).join(r.choices(words, k=r.choice([3, 60, 400]))) for _ in range(60)] + ["\n".join(r.choices([" ".join(r.choices(words, k=6)) for _ in range(5)], k=12)) for _ in range(20)]


def test_quality_statistics(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = quality.apply_rules(df).collect()
    assert len(got) == len(texts)
    for g in got:
        s = brute_stats(texts[g.doc_id])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.n_lines) == s, texts[g.doc_id]
        assert g.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        rejected = g.base_failed or 4 * s[2] > s[0] or 2 * s[3] > s[5] or s[1] < 2 * s[0] or s[1] > 14 * s[0]
        assert g.kept == (not rejected)


def test_cascade_order_does_not_change_the_verdict(spark):
    df = spark.createDataFrame([(t,) for t in corpus()], "text string")
    rules = [quality.base_rule(), *quality.default_rules()]
    planned = quality.plan_cascade(df, rules, sample_rows=30)
    assert {r.name for r, _, _ in planned} == {r.name for r in rules}
    assert [s / c for _, c, s in planned] == sorted((s / c for _, c, s in planned), reverse=True)
    m = quality.measure(df)
    results = {tuple(r[0] for r in m.select(quality.cascade(order)).collect()) for order in (rules, rules[::-1], [r for r, _, _ in planned])}
    assert len(results) == 1
    assert quality.apply_rules(df.limit(0)).count() == 0


def test_keep_returns_the_kept_rows_with_their_own_columns(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, f"c{i}", i % 2 == 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept boolean")
    want = {g.doc_id for g in quality.apply_rules(df.drop("kept")).collect() if g.kept}
    got = quality.keep(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in df.collect() if r.doc_id in want)


# mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    r = random.Random(seed)
    names = [*(f"s{i}" for i in range(7)), "Zé", "", None]
    rows = []
    for i in range(3000):
        s = "s0" if r.random() < 0.4 else r.choice(names)
        rows.append((i, s, " ".join("x" * r.choice([1, 1, 2, 9, 40, 200])), "clash"))
    rows += [(5000, "s1", None, ""), (5001, "only empty", "", ""), (5002, "s1", " \n ", ""), (None, "s2", "a b", ""), (7, "s3", "a b c", ""), (7, "s3", "a b c", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string").repartition(6)
    got = mixing.mix(df).collect()
    assert sorted(str((g.doc_id, g.source, g.size)) for g in got) == sorted(str((i, s, len(WORD.findall(t or "")))) for i, s, t, _ in rows)
    sizes = collections.Counter()
    for i, s, t, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), collections.Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and math.isclose(g.target, want[g.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= g.copies <= 3
        taken[g.source] += g.copies * g.size
    longest = max(g.size for g in got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2 * longest, 0.01 * t), (s, taken[s], t)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert not re.search("Python|Pandas|Arrow", plan_of(mixing.mix(df)))


def test_mix_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", "x y"), (2, "a", "x y")], schema)).collect()
    assert sum(g.copies * g.size for g in got) == 4
    assert [g.copies for g in mixing.mix(spark.createDataFrame([(1, None, None)], schema)).collect()] == [1]


# chat


def brute_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    bits = ["\\", "#", "<", "### ", "</turn>\n", "\\s", "\\h", "\\0", ": ", "\n", "a", "é🙂", "", "assistant"]
    r = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "a: b#<\\", "", None]), r.choice([None, *("".join(r.choices(bits, k=5)) for _ in range(6))]), "x"))
    rows += [(None, 0, "user", "q", "x"), (None, 1, "assistant", "a", "x"), (900, 3, "user", "u", "x"), (900, 3, "user", "u", "x"), (901, None, "assistant", "n", "x"), (901, 0, "user", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string").repartition(3)
    examples = chat.expand(df)
    got = {g.conv_id: g for g in chat.read_back(examples).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")):
        want[c].append((role, text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].replies == [t for role, t in turns if role == "assistant"]
    by = collections.defaultdict(list)
    for e in examples.collect():
        by[e.conv_id].append(e)
    for c, es in by.items():
        es.sort(key=lambda e: e.example)
        whole = got[c].formatted
        assert [e.last for e in es] == [False] * (len(es) - 1) + [True]
        for e in es:
            assert whole.startswith(e.prompt + (e.completion or ""))
            assert e.completion is None or e.prompt.endswith("### assistant: ")
        assert es[-1].prompt + (es[-1].completion or "") + es[-1].tail == whole
    assert sorted(map(str, (tuple(g)[0] for g in chat.read_back(chat.expand(df)).collect()))) == sorted(map(str, want))
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# line dedup


def edit_within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_dropped(rows, min_words):
    lines = []
    for d, text in {(d, t) for d, t, *_ in rows if t is not None}:
        for k, x in enumerate(text.split("\n")):
            n = [w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w]
            if n:
                lines.append(((d is not None, d or 0, k), d, text, k, n))
    lines.sort(key=lambda x: x[0])
    out = set()
    for i, (_, d, t, k, n) in enumerate(lines):
        for _, _, _, _, m in lines[:i]:
            if m == n or len(m) >= min_words and len(n) >= min_words and edit_within_one(m, n):
                out.add((d, t, k))
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(6)] + ["é"]
    pool = [r.choices(words, k=r.choice([3, 7, 8, 9, 12, 30, 90])) for _ in range(40)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                kind, at = r.choice("adc"), r.randrange(len(x))
                if kind == "a":
                    x.insert(at, r.choice(words))
                elif kind == "d" and len(x) > 1:
                    x.pop(at)
                else:
                    x[at] = r.choice(words)
            lines.append(r.choice([" ", "  ", "\t"]).join(x))
        rows.append((d, "\n".join(lines), "s", 1))
    rows += [(200, None, "s", 1), (201, "", "s", 1), (202, "\n\n \n", "s", 1), (203, rows[3][1], "s", 1), (7, rows[7][1], "s", 1), (None, "a b c\nno id", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nth string, n_near long").repartition(4)
    gone = brute_dropped(rows, 8)
    want = sorted(str((d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, t, k) not in gone))) for d, t, *_ in rows)
    out = line_dedup.dedup_lines(df)
    assert sorted(str((g.doc_id, g.text)) for g in out.collect()) == want
    assert sum(g.n_near for g in out.collect()) > 0
    assert out.columns == ["doc_id", "text", "nth", "n_lines", "n_dropped", "n_near"]
    assert not re.search("Python|Pandas|Arrow", plan_of(out))


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "small_side", lambda df, *a: df)
    test_line_dedup(spark, 5)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("a,b", [("a", "a"), ("a b c", "a x c"), ("a b c", "a c"), ("a c", "a b c"), ("a b", "b a"), ("a a b", "a b"), ("a b c d", "a b"), ("b c", "a b c"), ("a b", "a b c"), ("a b c", "x y c"), ("q a b", "a b c")])
def test_within_one_edit(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(line_dedup.within_one_edit(F.col("a"), F.col("b"))).first()[0]
    assert got == edit_within_one(a.split(), b.split())
