"""Clashing names, shuffle instead of broadcast, other session settings, bounded groups."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryfield.llm import chat, common, line_dedup, mixing, pii, quality, simhash, sstable, token_counts, topk
from quarryfield.llm.common import work_dir

from .test_search import VECTORS, brute_top

OWN = ["_split", "_gone", "_near", "_n", "_text_row", "_size", "_copy", "_copies", "_row", "_id", "_s", "_q_words", "_q_text", "text_row", "split", "of", "of_row", "gone", "near", "size", "copies", "n", "nth", "of_source", "of_size"]


def named(spark):
    """Documents whose other columns bear the names that the operators use inside."""
    texts = ["the quick brown fox jumps over the lazy dog again\nb c", "the quick brown fox jumps over the lazy cat again\nb c", "alone", "b c", None, "alone"]
    rows = [(i, t, "s1" if i % 2 else "s0", *(f"{c}{i}" for c in OWN)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in OWN)), rows


def test_columns_of_any_name_pass_through(spark):
    df, rows = named(spark)
    own = {r[0]: r[3:] for r in rows}
    for out in (line_dedup.dedup_lines(df), mixing.mixed(df, weights=(1,)), simhash.distinct_documents(df), quality.measure(df), quality.apply_rules(df), quality.keep(df, [])):
        assert set(df.columns) <= set(out.columns)
        for g in out.collect():
            assert tuple(g[c] for c in OWN) == own[g.doc_id]
    assert {g.doc_id: g.text for g in line_dedup.dedup_lines(df).collect()}[1] == ""
    assert sorted(g.doc_id for g in simhash.distinct_documents(df).collect()) == [0, 1, 2, 3, 4]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_LIMIT_BYTES", 0)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def texts(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    out = [" ".join(r.choices(words, k=r.choice([0, 3, 40, 400]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(out + out[:20])]


def test_token_counts_beyond_the_broadcast_limit(spark, no_broadcast, tmp_path):
    df = spark.createDataFrame(texts(1), "doc_id long, text string").repartition(3)
    out = token_counts.count_tokens(df, cache=f"{tmp_path}/cache")
    got = sorted((g.doc_id, g.n_tokens) for g in out.collect())
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    again = sorted((g.doc_id, g.n_tokens) for g in token_counts.count_tokens(df, cache=f"{tmp_path}/cache").collect())
    assert got == again and len(got) == 80


def test_a_large_cache_is_not_broadcast_for_one_new_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_LIMIT_BYTES", 30 * token_counts._ROW_BYTES)
    first = spark.createDataFrame(texts(2), "doc_id long, text string")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert not hinted(token_counts.count_tokens(first, cache=f"{tmp_path}/cache"))
    new = spark.createDataFrame([(1, "one new text")], "doc_id long, text string")
    out = token_counts.count_tokens(new, cache=f"{tmp_path}/cache")
    assert not hinted(out) and out.first()["n_tokens"] > 0
    assert hinted(token_counts.count_tokens(new, cache=f"{tmp_path}/other"))


def test_simhash_beyond_the_broadcast_limit(spark, no_broadcast):
    df = spark.createDataFrame(texts(3), "doc_id long, text string").repartition(3)
    got = {g.doc_id: g.component_id for g in simhash.near_duplicates(df, cell_rows=1).collect()}
    assert all(got[60 + i] == got[i] for i in range(20))


def test_mix_does_not_depend_on_the_session(spark):
    r = random.Random(6)
    rows = [(None if i % 5 == 0 else i, f"s{r.randrange(5)}", "x " * r.choice([1, 2, 2, 9]) + str(i)) for i in range(400)]
    df, results = spark.createDataFrame(rows, "doc_id long, source string, text string"), []
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(g.text for g in mixing.mixed(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert results[0] == results[1]


def test_repeated_rows_share_copies_exactly(spark):
    rows = [(1, "a", "x y z")] * 7 + [(2, "a", "x y")] * 2 + [(3, "b", "q " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = mixing.mix(df, weights=(1, 3)).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(df, weights=(1, 3)).count() == taken


def test_targets_of_many_sources(spark, tmp_path):
    from .test_native import brute_targets

    r = random.Random(8)
    sizes = {f"host{i}": r.choice([0, 1, 5, 100, 5000]) for i in range(600)} | {None: 77, "": 3, "Zé": 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = brute_targets(sizes)
    for g in mixing.source_targets(df, str(tmp_path)).collect():
        assert abs(g.target - want[g.source]) <= 1e-9 * max(1, want[g.source]), g


def test_the_grid_is_the_range_join(spark):
    """All pairs within Manhattan distance 3 of the segments' bit counts share a cell; the distance never exceeds the bits that differ."""
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(40)]
    for x in fps[:40]:
        for _ in range(4):
            y = x
            for _ in range(r.randint(1, 5)):
                y ^= 1 << r.randrange(64)
            if r.random() < 0.5:  # swapped bits of a segment leave the counts as they are
                s = 2 * r.randrange(32)
                y = y & ~(3 << s) | (y >> s & 1) << s + 1 | (y >> s + 1 & 1) << s
            fps.append(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    words = [g[0] % (1 << 64) for g in spark.createDataFrame([(x,) for x in signed], "fp long").select(simhash.embedded()).collect()]
    counts = [[bin(x >> 2 * i & 3).count("1") for i in range(32)] for x in fps]
    masks = simhash.cell_masks(3)
    for i in range(len(fps)):
        for j in range(i):
            manhattan = sum(abs(a - b) for a, b in zip(counts[i], counts[j]))
            assert manhattan == bin(words[i] ^ words[j]).count("1") <= bin(fps[i] ^ fps[j]).count("1")
            if manhattan <= 3:
                assert any(words[i] & m == words[j] & m for m in masks)


@pytest.mark.parametrize("shift", [0.0, -3.0])
def test_top_k_prunes_by_length_and_stays_exact(spark, shift, monkeypatch):
    """Vectors of very different lengths, so that most rows are never scored; negative scores throughout with a shift."""
    r = random.Random(7)
    rows = []
    for i in range(400):
        scale = r.choice([0.01, 0.1, 1.0, 10.0])
        rows.append((i, [scale * r.gauss(0, 1) + (shift if i % 20 else -shift) for _ in range(8)], ""))
    monkeypatch.setattr(topk, "_CELLS", 1500)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, lists=2).collect()
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == brute_top(rows, 5, 20)


def test_candidates_are_those_that_reach_their_share():
    r = np.random.default_rng(3)
    q, x = np.floor(r.normal(0, 300, (6, 10))), np.floor(r.normal(0, 300, (500, 10)) * r.choice([0.01, 0.1, 1], (500, 1)))
    cut = np.sort(q @ x.T, axis=1)[:, -5]
    by_length = []
    for s in topk._slices(10, 3):
        length = np.sqrt(np.square(x[:, s]).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        by_length.append((s, order, length[order]))
    i, j = topk._collect(q, x, cut, by_length)
    found = set(zip(i.tolist(), j.tolist()))
    want = {(a, b) for a in range(6) for b in range(500) if any(q[a, s] @ x[b, s] >= np.ceil(cut[a] / 3) for s, _, _ in by_length)}
    assert found == want and len(want) < 6 * 500 / 4
    assert {(a, b) for a in range(6) for b in range(500) if q[a] @ x[b] >= cut[a]} <= want


def test_long_mail_names_and_many_spans():
    name = "a" * 5000
    assert (0, 0, 5000 + len(" (at) example (dot) com")) in pii.more_candidates(f"{name} (at) example (dot) com")
    spans = [{"start": 3 * i, "end": 3 * i + 2} for i in range(50_000)]
    began = time.perf_counter()
    assert pii._apart([{"start": 3 * i + 2, "end": 3 * i + 3} for i in range(49_999)], spans) == [{"start": 3 * i + 2, "end": 3 * i + 3} for i in range(49_999)]
    assert pii._apart([{"start": 3 * i + 1, "end": 3 * i + 4} for i in range(49_999)], spans) == []
    began = time.perf_counter()
    pii.more_candidates("x" * 300_000 + " at " + "y" * 300_000)
    assert time.perf_counter() - began < 5
    r = random.Random(2)
    for _ in range(200):
        make = lambda n: sorted(({"start": a, "end": a + r.randint(1, 9)} for a in (r.randrange(80) for _ in range(n))), key=lambda s: s["start"])
        base, more, taken = make(6), make(8), []
        for s in more:
            if all(s["end"] <= x["start"] or s["start"] >= x["end"] for x in base + taken):
                taken.append(s)
        assert pii._apart(more, base) == taken


def test_a_changed_prompt_shows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(3) for t in range(8)]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {g.conv_id: g.formatted is None for g in chat.read_back(examples).collect()} == {0: False, 1: False, 2: False}
    spoilt = examples.withColumn("prompt", F.when((F.col("conv_id") == 1) & (F.col("example") == 2), F.replace("prompt", F.lit("text 1 0"), F.lit("text 1 X"))).otherwise(F.col("prompt")))
    assert {g.conv_id: g.formatted is None for g in chat.read_back(spoilt).collect()} == {0: False, 1: True, 2: False}


def test_repeated_ids_over_several_shards(spark):
    rows = [(7 if i % 2 else i, f"text number {i}") for i in range(400)] + [(None, f"none {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = sstable.write_shards(df, f"{work_dir(spark, 'test')}/t", shards=6)
    assert manifest.count() >= 4
    assert len(sstable.lookup(spark, manifest, 7)) == 200 and len(sstable.lookup(spark, manifest, None)) == 100 and len(sstable.lookup(spark, manifest, 8)) == 1
    back = [g.doc_id for g in sstable.read_shards(manifest).orderBy("start").collect()]
    assert back == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
