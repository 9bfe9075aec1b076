"""The pipeline, stage by stage, against brute force."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryfield.llm import mixing, simhash
from quarryfield.llm.encoders import encoder, tokenizer_path

from .test_native import WORD, brute_dropped, brute_stats, brute_targets
from .test_tokens import brute_best_fit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    line = lambda n: " ".join(r.choices(words, k=n))
    texts = ["\n".join(line(r.choice([9, 20, 60])) for _ in range(r.randint(3, 9))) for _ in range(60)]
    shared = line(55)
    texts += [t + "\n" + shared for t in texts[:10]]
    texts += texts[10:15]
    for t in texts[15:30]:  # copies with a changed word in every line
        lines = [x.split(" ") for x in t.split("\n")]
        for x in lines:
            x[r.randrange(len(x))] = "changed"
        texts.append("\n".join(" ".join(x) for x in lines))
    for _ in range(8):  # one-line documents whose copies are far beyond one edit
        x = r.choices(words, k=500)
        texts.append(" ".join(x))
        for _ in range(3):
            y = x[:]
            for _ in range(6):
                y[r.randrange(500)] = r.choice(words)
            texts.append(" ".join(y))
    texts += ["spam " * 300, "### " * 80, "", None, "short text", line(3000)]
    return [(i, t, "en", None if i % 13 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def stage(i, df):
        out = corpus_pipeline.STAGES[i][1](spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        return spark.read.parquet(f"{tmp_path}/{i}")

    one = stage(0, docs)
    want = []
    for d in rows:
        s = brute_stats(d[1])
        if not (s[0] < 50 or 100 * s[4] > 50 * s[0] or 4 * s[2] > s[0] or 2 * s[3] > s[5] or s[1] < 2 * s[0] or s[1] > 14 * s[0]):
            want.append(d)
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(want, key=str)

    two = stage(1, one)
    gone = brute_dropped(want, 8)
    want = [(d, t, lang, s, len(t)) for d, t, lang, s in ((d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, t, k) not in gone), lang, s) for d, t, lang, s, _ in want)]
    assert sorted(map(tuple, two.collect()), key=str) == sorted(want, key=str)

    three = stage(2, two)
    sets = {d: set(zip(*(w[i:] for i in range(5)))) or {tuple(w)} for d, w in ((x[0], (x[1] or "").lower().split()) for x in want)}
    group = {d: d for d in sets}
    for d in sorted(sets):
        for e in sorted(sets):
            if e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                group = {k: group[e] if v == group[d] else v for k, v in group.items()}
    keep = {min(d for d in sets if group[d] == g) for g in set(group.values())}
    want = [x for x in want if x[0] in keep]
    assert sorted(map(tuple, three.collect()), key=str) == sorted(want, key=str)
    assert len(keep) < len(sets) - 10

    four = stage(3, three)
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter()
    for x in want:
        sizes[x[3]] += len(WORD.findall(x[1]))
    for x in four.collect():
        taken[x.source] += len(WORD.findall(x.text))
        copies[tuple(x)] += 1
    assert set(copies) <= set(want) and max(copies.values()) <= 3
    longest = max(len(WORD.findall(x[1])) for x in want)
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * longest

    last = corpus_pipeline.STAGES[4][1](spark, four, str(tmp_path)).collect()
    tok, expect = encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer, []
    for x in four.collect():
        ids = tok.encode(x.text, add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        expect += [(x.doc_id, k, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((g.doc_id, g.piece, g.length, zlib.crc32(bytes(g.ids))) for g in last) == sorted(expect)
    used = collections.Counter()
    for g in last:
        used[g.sequence_id] += g.length
    assert max(used.values()) <= 1024 and len(used) == brute_best_fit([g.length for g in last], 1024)


def test_run_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("edits,least", [(5, 0.99), (9, 0.96), (11, 0.94)])
def test_recall_of_near_copies(spark, edits, least):
    """Pairs of 500-word texts with that many changed words: similarity about 0.90, 0.83 and 0.80."""
    r = random.Random(edits)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(150):
        x = r.choices(words, k=500)
        y = x[:]
        for k in r.sample(range(5, 495), edits):
            y[k] = r.choice(words)
        a, b = (set(zip(*(w[j:] for j in range(5)))) for w in (x, y))
        if len(a & b) >= 0.8 * len(a | b):
            rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(y))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {g.doc_id for g in simhash.distinct_documents(df).collect()}
    assert {d for d, _ in rows if d % 2 == 0} <= kept
    found = sum(d % 2 == 1 and d not in kept for d, _ in rows)
    assert found >= least * len(rows) / 2, (found, len(rows) / 2)


def test_similar_pairs_behind_rejected_candidates(spark):
    """Copies of one text that are near it and not near each other; candidate groups over several tasks."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(3):
        x = r.choices(words, k=300)
        texts = [x]
        for _ in range(1000 if g == 0 else 30):
            y = x[:]
            for k in r.sample(range(5, 295), r.randint(3, 6)):
                y[k] = r.choice(words)
            texts.append(y)
        r.shuffle(texts)
        rows += [(len(rows) + i, " ".join(y)) for i, y in enumerate(texts)]
    sets = {d: set(zip(*(t.split()[i:] for i in range(5)))) for d, t in rows}
    root = {d: d for d in sets}
    starts = (0, 1001, 1032, 1063)
    for lo, hi in zip(starts, starts[1:]):
        for d in range(lo, hi):
            for e in range(lo, d):
                if root[d] != root[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                    a, b = root[e], root[d]
                    root.update({k: min(a, b) for k in range(lo, hi) if root[k] in (a, b)})
    want = {d for d in sets if root[d] == d}
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(g.doc_id for g in got.collect()) == sorted(want)


def test_every_pair_of_a_large_group_is_tried(spark, tmp_path):
    """A chain of candidates that are not similar, except for pairs far apart in it."""
    sets = [(i, [i * 100 + j for j in range(10)]) for i in range(60)]
    sets += [(60 + i, [i * 100 + j for j in range(9)]) for i in range(0, 60, 7)]
    nodes = [n for n, _ in sets]
    pairs = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    table = spark.createDataFrame(sets, "node long, shingles array<long>")
    got = simhash._similar(pairs, table, 0.8, f"file://{tmp_path}/similar", group_rows=8).collect()
    assert {(min(g), max(g)) for g in got} == {(i, 60 + i) for i in range(0, 60, 7)}


def test_recall_of_repeated_passages(spark):
    """Texts with nearly the same shingle set, one of which repeats a passage."""
    r = random.Random(8)
    words, rows = [f"w{i}" for i in range(5000)], []
    for i in range(60):
        x = r.choices(words, k=122)
        y = x[:62] + x[50:62] * (3 + i % 4) + x[62:]
        a, b = (set(zip(*(w[j:] for j in range(5)))) for w in (x, y))
        assert len(a & b) >= 0.9 * len(a | b)
        rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(y))]
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g.doc_id for g in got) == list(range(0, 120, 2))


def test_distinct_documents_edges(spark):
    t = " ".join(f"a{i}" for i in range(100))
    rows = [(5, t, "x"), (3, t, "x"), (3, t, "x"), (None, t, "x"), (9, None, "x"), (8, " ", "x"), (7, "one two", "x"), (6, "One two", "y"), (4, "one three", "x")]
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted((g.doc_id, g.text) for g in got) == sorted([(3, t), (8, " "), (6, "One two"), (4, "one three")])


def test_texts_under_one_dominating_shingle(spark):
    rows = [(i, "spam " * 300 + " ".join(f"{c}{k}" for k in range(40))) for i, c in enumerate("abcd")]
    rows += [(4, "spam " * 200 + " ".join(f"a{k}" for k in range(40)))]  # the same shingles as the first
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g.doc_id for g in got) == [0, 1, 2, 3]


def test_equal_fingerprints_are_decided_on_shingles(spark, monkeypatch):
    """Four texts of which all have the same wide fingerprint."""
    rows = [(i, " ".join(f"{c}{k}" for k in range(40))) for i, c in enumerate("abc")] + [(3, " ".join(f"a{k}" for k in range(40)) + " end")]
    wide = simhash._wide

    def same(docs, shingle):
        return wide(docs, shingle).withColumn("wide", F.array(*[F.lit(1).cast("long")] * simhash.WIDE_WORDS))

    monkeypatch.setattr(simhash, "_wide", same)
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g.doc_id for g in got) == [0, 1, 2]


def test_different_texts_with_one_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (4, text("c")), (4, text("d")), (7, text("e")), (7, text("e"))]
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:5], key=str)


def test_mixed_repeats_documents(spark):
    rows = [(i, "s" if i % 3 else None, "x " * (i % 7), str(i)) for i in range(200)] + [(1, "s", "x x x x", "dup"), (None, "s", "y", "none")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, extra string")
    got = mixing.mixed(df)
    assert got.columns == df.columns
    by = {(g.doc_id, g.source, g.size): g.copies for g in mixing.mix(df).collect()}
    counts = collections.Counter(tuple(g) for g in got.collect())
    for d, s, t, e in rows:
        assert counts[(d, s, t, e)] == by[(d, s, len(WORD.findall(t)))]


def test_candidates_agree_on_segment_counts(spark, monkeypatch):
    """Near copies whose fingerprints differ in one segment of every 16 bits, never in its bit count."""
    words = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "end"])), (2, " ".join(f"x{i}" for i in range(100)))]
    wide, one, other = simhash._wide, 0x1111111111111111, 0x1112111211121112

    def given(docs, shingle):
        fps = [F.array(*[F.lit(x)] * simhash.WIDE_WORDS) for x in (one, other, ~one)]
        return wide(docs, shingle).withColumn("wide", F.when(F.col("doc_id") == 0, fps[0]).when(F.col("doc_id") == 1, fps[1]).otherwise(fps[2]))

    monkeypatch.setattr(simhash, "_wide", given)
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g.doc_id for g in got) == [0, 2]


def test_wide_cells_against_brute_force():
    r = np.random.default_rng(3)
    wide = r.integers(0, 1 << 64, (40, simhash.WIDE_WORDS), dtype=np.uint64)
    wide[20:] = wide[:20] ^ (np.uint64(1) << r.integers(0, 64, (20, simhash.WIDE_WORDS), dtype=np.uint64))
    dealt = simhash._dealt_segments()
    assert dealt.shape == (153, 10) and all(len(set(kind)) == 10 for kind in dealt.tolist())
    counts = [[f"{w:064b}"[i : i + 2].count("1") for w in fp for i in range(0, 64, 2)] for fp in wide.tolist()]
    want = [[(k, *(c[i] for i in kind)) for k, kind in enumerate(dealt.tolist())] for c in counts]
    got = simhash._wide_cells(wide)
    assert len({(x, y) for a, b in zip(got.tolist(), want) for x, y in zip(a, b)}) == len(np.unique(got)) == len({x for b in want for x in b})


def test_close_pairs_of_cells_against_brute_force():
    r, rows = np.random.default_rng(4), []
    for cell, size in enumerate([1, 2, 3, 16, 17, 60, 300, 5, 1, 2]):
        fps = r.integers(0, 1 << 64, (size, 4), dtype=np.uint64)
        for i in range(1, size):  # some are copies of an earlier one with about a ninth of the bits changed
            if r.random() < 0.6:
                flips = np.packbits(r.random((4, 64)) < 0.16 * r.random() + 0.05, axis=1).view(">u8").astype(np.uint64).ravel()
                fps[i] = fps[r.integers(0, i)] ^ flips
        rows += [(cell, len(rows) + i, fp) for i, fp in enumerate(fps)]
    bits = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(x.tolist(), y.tolist()))
    close = {(i, j) for c, i, x in rows for d, j, y in rows[i + 1 :] if c == d and bits(x, y) <= simhash.SKETCH_BITS}
    cols = [np.array([x[0] for x in rows], dtype=np.int32), np.array([x[1] for x in rows]), *np.array([x[2] for x in rows]).view(np.int64).T]
    table = pa.Table.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=[f"c{i}" for i in range(6)])
    found = {(min(a, b), max(a, b)) for batch in simhash._link_wide(iter(table.to_batches(max_chunksize=50))) for a, b in zip(*(c.to_pylist() for c in batch.columns))}
    assert found <= close

    def roots(pairs):
        root = list(range(len(rows)))
        for i, j in sorted(pairs):
            lo, hi = sorted((root[i], root[j]))
            root = [lo if x == hi else x for x in root]
        return root

    assert roots(found) == roots(close) and 100 < len(found) < len(close)
