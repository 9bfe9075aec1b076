"""Packing, token counts and shards against brute force with the tokenizers library."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quarryfield.llm import packing, sstable, token_counts
from quarryfield.llm.encoders import encoder, tokenizer_path

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("digest", T.IntegerType())])


def documents(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["naïve", "日本", "<|endoftext|>", "Don't", "\n\n"]
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 5, 50, 700, 1500]))) for _ in range(120)]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(500, None, "x", 1), (501, "", None, 1), (502, "a b " * 9000, "x", 1), (3, texts[3], "x", 1), (3, "other", "x", 1), (None, "no id", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def ids_of(name, text):
    return encoder(tokenizer_path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing_against_brute_force(spark):
    df, rows = documents(spark)
    got = packing.pack(df.repartition(5)).collect()
    want = []
    for d, text, *_ in rows:
        ids = ids_of("byte_bpe_50k.json", text) + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((g.doc_id, g.piece, g.start, g.length, zlib.crc32(bytes(g.ids))) for g in got), key=key) == sorted(want, key=key)
    seqs = {}
    for g in got:
        seqs.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= math.ceil(sum(w[3] for w in want) / 1024) + 1


def brute_best_fit(lengths, cap):
    free = []
    for n in sorted(lengths, reverse=True):
        room = min((f for f in free if f >= n), default=None)
        if room is None:
            free.append(cap - n)
        else:
            free.remove(room)
            free.append(room - n)
    return len(free)


@pytest.mark.parametrize("seed", range(30))
def test_plan_uses_as_many_sequences_as_best_fit_decreasing(seed):
    r = random.Random(seed)
    cap = r.choice([1, 7, 64, 100])
    counts = {n: r.choice([1, 2, 9, 60]) for n in r.sample(range(1, cap + 1), r.randint(1, min(cap, 30)))}
    plan = packing.plan_slots(counts, cap)
    used = {}
    for n, total in counts.items():
        rows = [tuple(map(int, x)) for x in plan if x[0] == n]
        for (_, lo, first, each, offset), hi in zip(rows, [x[1] for x in rows[1:]] + [total]):
            for k in range(hi - lo):
                used.setdefault(first + k // each, []).append((offset + k % each * n, n))
    for s in used.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= cap
    lengths = [n for n, c in counts.items() for _ in range(c)]
    assert sum(map(len, used.values())) == len(lengths)
    assert len(used) == brute_best_fit(lengths, cap)


def test_counts_and_cache(spark, tmp_path):
    df, rows = documents(spark)
    cache = f"file://{tmp_path}/cache"
    want = sorted((str(d), len((t or "").encode()), len(ids_of("byte_bpe_50k.json", t))) for d, t, *_ in rows)
    for _ in range(2):
        got = token_counts.count_tokens(df, cache=cache).collect()
        assert sorted((str(g.doc_id), g.n_bytes, g.n_tokens) for g in got) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in rows})
    more = spark.createDataFrame([(900, "quite new", "x", 1), (1, rows[1][1], "x", 1)], SCHEMA)
    assert {g.doc_id: g.n_tokens for g in token_counts.count_tokens(more, cache=cache).collect()}[900] == len(ids_of("byte_bpe_50k.json", "quite new"))
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows}) + 1


def test_shards_round_trip(spark, tmp_path):
    df, rows = documents(spark)
    manifest = sstable.write_shards(df.repartition(3), folder=f"file://{tmp_path}/tokens", shards=3)
    got = sstable.read_shards(manifest).collect()
    name = "word_bpe_49k.json"
    assert sorted((str(g.doc_id), bytes(g.ids)) for g in got) == sorted((str(d), np.array(ids_of(name, t) + [2], dtype="<u4").tobytes()) for d, t, *_ in rows)
    at, last = 0, None
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at and (last is None or g.doc_id >= last)
        at, last = at + len(g.ids) // 4, g.doc_id
    assert sorted(sstable.lookup(spark, manifest, 3)) == sorted(np.array(ids_of(name, t) + [2], dtype="<u4").tobytes() for d, t, *_ in rows if d == 3)
    assert len(sstable.lookup(spark, manifest, None)) == 1 and sstable.lookup(spark, manifest, 10**9) == []
    by_name = sstable.write_shards(df.selectExpr("concat('doc-', doc_id) AS doc_id", "text"), shards=2)
    assert len(sstable.lookup(spark, by_name, "doc-502")) == 1
    assert {g.doc_id for g in sstable.read_shards(by_name, text_ids=True).collect()} == {None if r[0] is None else f"doc-{r[0]}" for r in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert sstable.read_shards(sstable.write_shards(none)).count() == 0
