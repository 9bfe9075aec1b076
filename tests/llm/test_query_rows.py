"""The rows of the registered queries on the driver's documents, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from quarryfield.llm import queries

from .test_native import WORD, brute_dropped, brute_targets
from .test_search import brute_components, brute_fp
from .test_tokens import brute_best_fit, crc, ids_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_packing(spark, docs):
    got, want = rows_of(spark, "op1_best_fit_packing"), []
    for d, text, _ in docs:
        ids = ids_of("byte_bpe_50k.json", text) + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(g)[:5] for g in got) == sorted(want)
    held = collections.defaultdict(list)
    for g in got:
        held[g.sequence_id].append((g.offset, g.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) == brute_best_fit([g.length for g in got], 1024)


def test_token_counts(spark, docs):
    counts = {d: len(ids_of("byte_bpe_50k.json", text)) for d, text, _ in docs}
    assert sorted(map(tuple, rows_of(spark, "op3_token_counts"))) == sorted((d, len((t or "").encode()), counts[d], counts[d] > 1024) for d, t, _ in docs)


def brute_spans(text):
    """The patterns of the contract, each by itself."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(digits)))
        out += [(m.start(), 2, m.end())] * (12 <= len(digits) <= 19 and doubled % 10 == 0)
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def test_personal_data(spark, docs):
    texts, found = {d: t or "" for d, t, _ in docs}, 0
    for g in rows_of(spark, "op4_personal_data"):
        base = brute_spans(texts[g.doc_id])
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in g.spans.split(",") if s)]
        assert [a for _, a, _ in spans] == sorted(a for _, a, _ in spans) and set(base) <= set(spans)
        added = sorted((a, b) for k, a, b in set(spans) - set(base))
        assert all(0 <= a < b <= len(texts[g.doc_id]) for a, b in added)
        assert all(b <= c for (_, b), (c, _) in zip(added, added[1:])) and all(b <= x or a >= y for a, b in added for _, x, y in base)
        found += len(spans)
    assert found > 0


def test_line_dedup(spark, docs):
    gone, want = brute_dropped([(d, t) for d, t, _ in docs], 8), {}
    for d, t, _ in docs:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if (d, t, k) not in gone]
        want[d] = (len(lines), len(lines) - len(kept), None if t is None else hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = rows_of(spark, "op5_line_dedup")
    assert {g.doc_id: (g.n_lines, g.n_dropped, g.text_sha256) for g in got} == want and sum(g.n_dropped for g in got) > 0


def test_shards(spark, docs):
    at, want = 0, []
    for d, text, _ in sorted(docs):
        ids = ids_of("word_bpe_49k.json", text) + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows_of(spark, "op6_token_id_shards"))) == want


def brute_rates(sizes, target, cap=3):
    """Rates of one source's documents: exponential in the size, by bisection on the multiplier."""
    mean = sum(sizes) / len(sizes)
    rates = lambda x: [min(cap, math.exp(min(x * s / mean, 50))) if s else 1 for s in sizes]
    if target >= cap * sum(sizes) * (1 - 1e-12):
        return [cap if s else 1 for s in sizes]
    low, high = -64.0, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(r * s for r, s in zip(rates(mid), sizes)) > target else (mid, high)
    return rates(low)


def test_source_mix(spark, docs):
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    totals, by = collections.Counter(), collections.defaultdict(list)
    for d, _, s in docs:
        totals[s] += size[d]
        by[s].append(d)
    targets = brute_targets(totals)
    got = {g.doc_id: g for g in rows_of(spark, "op7_source_mix")}
    assert set(got) == set(size)
    for s, mine in by.items():
        rates = brute_rates([size[d] for d in mine], targets[s])
        for d, rate in zip(mine, rates):
            g = got[d]
            assert (g.size, g.source_size) == (size[d], totals[s]) and math.isclose(g.target, targets[s], rel_tol=1e-9)
            copies = g.taken // g.size if g.size else 0
            assert g.taken == copies * g.size and copies <= 3
            if g.size:
                assert math.floor(rate - 1e-4) <= copies <= math.ceil(rate + 1e-4)
        assert abs(sum(got[d].taken for d in mine) - targets[s]) <= 1.5 * max(size[d] for d in mine)


def test_simhash(spark, docs):
    fps = {d: brute_fp(t, 3) for d, t, _ in docs}
    comp, least = brute_components(set(fps.values()), 3), {}
    for d, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], d), d)
    assert sorted(map(tuple, rows_of(spark, "op8_simhash_near_dedup"))) == sorted((d, f"{f:016x}", least[comp[f]]) for d, f in fps.items())
