"""Top-k search and SimHash against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryfield.llm import simhash, topk
from quarryfield.llm.components import connected_components
from quarryfield.llm.common import work_dir

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute_top(rows, k, step):
    fine = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in fine:
        if i % step == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, u in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in fine if i != q and len(v) == len(u))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("lists,block", [(4, 4096), (1, 7), (3, 5)])
def test_top_k(spark, lists, block):
    r = random.Random(lists)
    rows = [(i, [r.choice([-1.5, -0.3, 0.0, 0.7, 1.1]) for _ in range(6)], "x") for i in range(200)]
    rows += [(300 + i, [1.1] * 6, "x") for i in range(40)]  # one common vector
    rows += [(400, None, "x"), (410, [], "x"), (420, [float("nan")] * 6, "x"), (430, [None] * 6, "x"), (440, [float("inf")] * 6, None), (None, [1.0] * 6, "x")]
    rows += [(450, [1.0, 2.0], "x"), (451, [2.0, 2.0], "x"), (10, [0.7] * 6, "x"), (10, [1.1] * 6, "x"), (460, [3e30] * 3, "x"), (461, [-2e30] * 3, "x"), (462, [1.0] * 3, "x")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, lists=lists, block=block).collect()
    lim = (1 << 63) - 1
    want = [(q, a, i, max(-lim, min(lim, s))) for q, a, i, s in brute_top(rows, 10, 10)]
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], "")], VECTORS), F.lit(True)).count() == 0


def brute_fp(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, d):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= d:
                root[find(a)] = find(b)
    return {x: find(x) for x in fps}


def test_near_duplicates(spark):
    r = random.Random(3)
    words = [f"Wörd{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = r.choices(words, k=400)
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, 6])):
            copy = base[:]
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(400)] = r.choice(words)
            texts.append("\n".join(copy))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "É é"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (6, texts[5], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = simhash.near_duplicates(df, max_distance=6).collect()
    fps = {t: brute_fp(t, 3) for _, t, _ in rows}
    comp = brute_components(set(fps.values()), 6)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[comp[fps[t]]] = min(least.get(comp[fps[t]], i), i)
    want = sorted((str(i), fps[t], least[comp[fps[t]]]) for i, t, _ in rows)
    assert sorted((str(g.doc_id), g.fp % (1 << 64), g.component_id) for g in got) == want
    assert len(set(least.values())) < len(set(fps.values()))


@pytest.mark.parametrize("d,cell_rows", [(3, 1 << 12), (3, 3), (2, 3), (1, 2), (5, 1 << 12), (5, 4)])
def test_links_connect_what_all_links_connect(spark, d, cell_rows):
    r = random.Random(d)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(25):
            for _ in range(r.choice([1, 2, 3])):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.links(df, work_dir(spark, "test"), d, cell_rows)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > d).count() == 0
    roots = {g.node % (1 << 64): g.root for g in connected_components(edges, work_dir(spark, "test")).collect()}
    groups = {}
    for x, c in brute_components(fps, d).items():
        groups.setdefault(c, set()).add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(x for x in roots if roots[x] == c) for c in set(roots.values())}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    got = {g.node: g.root for g in connected_components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "test")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(200, 260)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long"), work_dir(spark, "test")).count() == 0


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
