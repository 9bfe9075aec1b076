"""Operator 8: near-duplicate documents by SimHash.

Fingerprints.  Words of the text in lower-case ASCII, their shingles hashed by XXH64; a bit
is 1 if set in over half of the hashes, repeats included.

Join.  Segment-popcount embedding: each fingerprint maps to the bit counts of its 32
segments of two bits.  A changed bit changes one count by one, so the Manhattan distance of
two count vectors is a lower bound of the Hamming distance.  Two vectors within Manhattan
distance 3 agree on all axes of at least three of six axis groups, so the range join becomes
equality on grid cells: the counts of one choice of three groups (20 choices).  Pairs that
meet in a cell are filtered by the Manhattan distance of all their counts, the lower bound,
and then verified on the fingerprints themselves.  For any other ``max_distance`` d there are
d + 3 groups, of which three agree.

Cells of more than ``CELL_ROWS`` members are divided by the fingerprints' own bits in the
cell's three groups.  No link is lost: two fingerprints within d bits have equal bits, and so
equal counts, in three groups, and the cells of that choice hold both, divided or not.

Only distinct fingerprints enter the join, and a cell gives a spanning forest of its links,
never all its pairs; connected components of the forests are those of all links.  A cell is
searched breadth-first over its unvisited members.

Cases: null and empty texts and texts of white space have fingerprint zero and link like any
other; null ids keep their rows and take the smallest id of their component, if there is one;
repeated ids and an empty table are allowed; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_side, text_or_empty, tidy, unused, work_dir
from .components import connected_components
from .encoders import slices

SEED = 42
#: Members of a grid cell beyond which it is divided.
CELL_ROWS = 1 << 12
_STEP = 1 << 15  # shingles at a time
_LOW_BITS = 0x5555555555555555


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in a column of 64-bit words: (n, w) to (w, 64).

    Bit-sliced: halves of the column are added plane by plane, as carry chains of whole
    words, until one row of planes is left; about ten word operations a word.
    """
    planes = [words]
    while len(planes[0]) > 1:
        n = len(planes[0])
        if n % 2:
            planes = [np.concatenate([p, np.zeros((1, p.shape[1]), dtype=np.uint64)]) for p in planes]
            n += 1
        added, carry = [], None
        for p in planes:
            x, y = p[: n // 2], p[n // 2 :]
            half = x ^ y
            added.append(half if carry is None else half ^ carry)
            carry = x & y if carry is None else (x & y) | (half & carry)
        planes = [*added, carry]
    shift = np.arange(63, -1, -1, dtype=np.uint64)
    out = np.zeros((words.shape[1], 64), dtype=np.int64)
    for i, p in enumerate(planes):
        out += ((p[0][:, None] >> shift) & np.uint64(1)).astype(np.int64) << i
    return out


def _grams(text: str, shingle: int) -> tuple[Iterator[tuple[bytes, ...]], int]:
    """Shingles and their number; fewer words than a shingle are one."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return iter(()), 0
    if len(words) < shingle:
        return iter([tuple(words)]), 1
    return zip(*(words[i:] for i in range(shingle))), len(words) - shingle + 1


def _hashes(grams: list[tuple[bytes, ...]], seed: int) -> np.ndarray:
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.frombuffer(b"".join([digest(join(g), seed) for g in grams]), ">u8").astype(np.uint64)


def fingerprint(text: str, shingle: int = 3, seed: int = SEED, words: int = 1) -> list[int]:
    """SimHash of 64 * ``words`` bits as unsigned words.

    The first word is of the shingles' XXH64 itself; further words come from the same hash
    by a multiply-and-shift mix with another odd constant each.
    """
    grams, n = _grams(text, shingle)
    counts = np.zeros((words, 64), dtype=np.int64)
    while part := list(itertools.islice(grams, _STEP)):
        counts += _bit_counts(_widen(_hashes(part, seed), words))
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits(2 * counts > n, axis=1)]


def _widen(h: np.ndarray, words: int) -> np.ndarray:
    cols = [h]
    for i in range(1, words):
        z = h + np.uint64((0x9E3779B97F4A7C15 * i) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        cols.append(z ^ (z >> np.uint64(31)))
    return np.stack(cols, axis=1)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch, 1024):
                fps = np.array([fingerprint(t, shingle)[0] for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(fps)], names=["doc_id", "fp"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", id_type), T.StructField("fp", T.LongType())]))


def cell_masks(max_distance: int) -> list[int]:
    """Bits of the embedded word that each kind of grid cell fixes: the choices of three out of d + 3 axis groups."""
    groups, bits = max_distance + 3, [0] * (max_distance + 3)
    for axis in range(32):
        bits[axis * groups // 32] |= 0b11 << 2 * axis
    return [sum(c) for c in itertools.combinations(bits, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(fps: np.ndarray, counts: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, breadth-first over what is unvisited.

    The Manhattan distance of the counts, a lower bound, decides which pairs are verified.
    """
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(counts[rest] ^ counts[at]) <= max_distance
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[at]) <= max_distance
            if near.any():
                found = rest[near]
                out += [(at, x) for x in found]
                queue += found.tolist()
                rest = rest[~near]
    return out


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The edges that join two trees, first come first kept."""
    parent: dict[int, int] = {}
    out = []

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _link_cells(max_distance: int):
    """Rows (cell, fingerprint, counts) sorted by cell: a spanning forest of each cell's links as pairs of fingerprints."""

    def finish(cells: np.ndarray, fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.diff(cells)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(cells)]])
        two = first[last - first == 2]
        two = two[np.bitwise_count(counts[two] ^ counts[two + 1]) <= max_distance]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_distance]
        a, b = [fps[near]], [fps[near + 1]]
        for lo, hi in zip(first[last - first > 2], last[last - first > 2]):
            found = _pairs(fps[lo:hi], counts[lo:hi], max_distance)
            if found:
                pairs = np.array(found) + lo
                a.append(fps[pairs[:, 0]])
                b.append(fps[pairs[:, 1]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def take(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            if parts:
                cells, fps, counts = (np.concatenate(c) for c in zip(*parts))
                a, b = finish(cells, fps.view(np.uint64), counts.view(np.uint64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cols = tuple(batch.column(i).to_numpy() for i in range(3))
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
            if cut:
                yield from take([*held, tuple(c[:cut] for c in cols)])
                held = []
            held.append(tuple(c[cut:] for c in cols))
        yield from take(held)

    return run


def embedded(fp: str = "fp") -> Column:
    """Bit count of each 2-bit segment, in place and in unary (00, 01, 11): two such words differ in as many bits as their Manhattan distance."""
    x, y, low = F.col(fp), F.shiftrightunsigned(fp, 1), F.lit(_LOW_BITS)
    return x.bitwiseOR(y).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(low), 1))


def links(nodes: DataFrame, where: str, max_distance: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``nodes``: fp (distinct).  Gives pairs a, b of fingerprints that link, enough to connect whatever all links connect."""
    masks = [_signed(m) for m in cell_masks(max_distance)]
    counted = nodes.withColumn("counts", embedded())
    cells = F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(masks))))
    grid = counted.select("fp", "counts", cells.alias("kind", "cell"))
    full = materialise(grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select("cell", F.lit(True).alias("full")), f"{where}/full-cells")
    fixed = F.col("fp").bitwiseAND(F.element_at(F.array(*(F.lit(m) for m in masks)), F.col("kind") + 1))
    n_full = full.count()
    if n_full:
        grid = grid.join(small_side(full, n_full, 24), "cell", "left").withColumn("cell", F.when(F.col("full"), F.xxhash64("cell", fixed)).otherwise(F.col("cell")))
    grid = grid.select("cell", "fp", "counts").repartition("cell").sortWithinPartitions("cell", "fp")
    return grid.mapInArrow(_link_cells(max_distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest id reachable over links of ``max_distance`` bits or fewer."""
    where = work_dir(docs.sparkSession, "simhash")
    marked = materialise(fingerprints(docs, shingle, id_col, text_col), f"{where}/fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{where}/distinct")
    roots = connected_components(links(distinct.select("fp"), where, max_distance, cell_rows), f"{where}/components")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    labels = placed.select("fp", "root").join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    labels = materialise(labels, f"{where}/labels")
    return marked.join(small_side(labels, labels.count(), 32), "fp", "left").select("doc_id", "fp", "component_id")


# Near copies by similarity: wide fingerprints for candidates, shingle sets for the decision.

#: Words of 64 bits, 32 segments of two bits each.
WIDE_WORDS = 16
#: Segments whose counts a candidate cell fixes, and how often all segments are dealt into cells.
CELL_SEGMENTS = 10
DEALS = 3
#: Words that travel with the cells, and how many of their bits may differ.  A pair at
#: similarity 0.8 differs in about a sixth of its bits, an unrelated one in half.
SKETCH_WORDS = 4
SKETCH_BITS = 60
#: Members of a cell up to which its pairs are compared along with those of other cells.
SMALL_CELL = 16
#: Members of a candidate group that meet in one task, and the pivots of a larger group's first round.
GROUP_ROWS = 128
FIRST_PIVOTS = 16


def _wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WIDE_WORDS bits over distinct shingle hashes, as the decision counts each shingle once."""
    counts = np.zeros((WIDE_WORDS, 64), dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        counts += _bit_counts(_widen(hashes[i : i + _STEP], WIDE_WORDS))
    return np.packbits(2 * counts > len(hashes), axis=1).view(">u8").astype(np.uint64).ravel()


def _distinct_hashes(text: str, shingle: int) -> np.ndarray:
    return np.unique(_hashes(list(_grams(text, shingle)[0]), SEED))


def _wide(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row (hash of the text), shingled (hash of the distinct shingles), wide fingerprint, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, texts in slices(batch.select([1, 2]), 1024):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                sets = [_distinct_hashes(t, shingle) for t in texts]
                fps = np.array([_wide_fingerprint(x) for x in sets], dtype=np.uint64).reshape(len(texts), WIDE_WORDS).view(np.int64)
                shingled = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * WIDE_WORDS), pa.array(fps.ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.int64()), pa.array(shingled), flat], names=["doc_id", "row", "shingled", "wide"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("shingled", T.LongType()), T.StructField("wide", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", "row", "text").mapInArrow(tidy(run), schema)


def _dealt_segments() -> np.ndarray:
    """The segments of each kind of candidate cell, one kind a row: every deal puts all segments in an order of its own."""
    order, segments = np.random.default_rng(SEED), 32 * WIDE_WORDS
    kinds = segments // CELL_SEGMENTS
    return np.concatenate([order.permutation(segments)[: kinds * CELL_SEGMENTS].reshape(kinds, CELL_SEGMENTS) for _ in range(DEALS)])


def _wide_cells(wide: np.ndarray) -> np.ndarray:
    """Cells of wide fingerprints, (n, WIDE_WORDS) to (n, kinds): the kind and the bit counts of its segments as one number."""
    bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(wide), 8 * WIDE_WORDS), axis=1)
    counts, dealt = bits[:, 0::2] + bits[:, 1::2], _dealt_segments()
    cells = np.tile(np.arange(len(dealt), dtype=np.int32), (len(wide), 1))
    for segment in dealt.T:
        cells = cells * np.int32(3) + counts[:, segment]
    return cells


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, wide): node, cells."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            cells = _wide_cells(part.column(1).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, WIDE_WORDS))
            ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * cells.shape[1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))], names=["node", "wide", "cells"])


def _unary(words: np.ndarray) -> np.ndarray:
    """``embedded`` for arrays."""
    low = np.uint64(_LOW_BITS)
    x, y = words, words >> np.uint64(1)
    return ((x | y) & low) | ((x & y & low) << np.uint64(1))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of arrays whose last axis holds the words."""
    return sum(np.bitwise_count(x[..., i] ^ y[..., i]).astype(np.uint16) for i in range(x.shape[-1]))


def _close_pairs(sketch: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs of one cell.

    The Manhattan distance of the counts, a lower bound, decides which pairs are verified on
    the bits.  A block of members meets all that are unvisited; who has links there is
    searched breadth-first, the others are done.
    """
    out, left = [], np.ones(len(sketch), dtype=bool)

    def near(some: np.ndarray, rest: np.ndarray) -> np.ndarray:
        x, y = np.nonzero(_differing(counts[some][:, None], counts[rest][None]) <= SKETCH_BITS)
        found = np.zeros((len(some), len(rest)), dtype=bool)
        found[x, y] = _differing(sketch[some[x]], sketch[rest[y]]) <= SKETCH_BITS
        return found

    while len(rest := np.flatnonzero(left)) > 1:
        block = rest[: max(1, min(32, (1 << 16) // len(rest)))]
        linked = near(block, rest).sum(axis=1) > 1  # each is close to itself
        left[block[~linked]] = False
        for start in block[linked].tolist():
            queue = [start] if left[start] else []
            left[start] = False
            while queue and len(rest := np.flatnonzero(left)):
                at = queue.pop()
                found = rest[near(np.array([at]), rest)[0]].tolist()
                out += [(at, x) for x in found]
                queue += found
                left[found] = False
    return out


def _link_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, sketch words) sorted by cell: close pairs that connect whatever each cell's close pairs connect."""

    def take(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        cells, nodes, *words = (np.concatenate(c) for c in zip(*parts))
        sketch = np.stack(words, axis=1).view(np.uint64)
        counts = _unary(sketch)
        cut = np.flatnonzero(np.diff(cells)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(cells)]])
        size = last - first
        left = np.repeat(last, size) - np.arange(len(cells)) - 1  # members of the cell after this one
        at, a, b = np.flatnonzero(np.repeat(size <= SMALL_CELL, size)), [], []
        for step in range(1, SMALL_CELL):
            at = at[left[at] >= step]
            x = at[_differing(counts[at], counts[at + step]) <= SKETCH_BITS]
            x = x[_differing(sketch[x], sketch[x + step]) <= SKETCH_BITS]
            a.append(nodes[x])
            b.append(nodes[x + step])
        for lo, hi in zip(first[size > SMALL_CELL], last[size > SMALL_CELL]):
            if found := _close_pairs(sketch[lo:hi], counts[lo:hi]):
                pairs = np.array(found) + lo
                a.append(nodes[pairs[:, 0]])
                b.append(nodes[pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy() for i in range(batch.num_columns))
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield from take([*held, tuple(c[:cut] for c in cols)])
            held = []
        held.append(tuple(c[cut:] for c in cols))
    yield from take(held)


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node, shingles: the sorted distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, texts in slices(batch, 256):
                sets = [_distinct_hashes(t, shingle).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(tidy(run), "node long, shingles array<long>")


def _decide(min_similarity: float):
    """Rows (key, pivot, node, shingles) sorted by key.

    Gives links a, b that connect whatever the key's members, and its pivots with its members,
    link at ``min_similarity``; where there are pivots also a row a, score for each member: the
    sum of its similarities to them.
    """

    def group(nodes: np.ndarray, pivot: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        words, flat = np.unique(flat, return_inverse=True)
        end = np.cumsum(sizes)

        def shared(i: int) -> np.ndarray:
            mine = np.zeros(len(words), dtype=bool)
            mine[flat[end[i] - sizes[i] : end[i]]] = True
            count = np.concatenate([[0], np.cumsum(mine[flat])])
            return count[end] - count[end - sizes]

        members, pivots, score, pairs = np.flatnonzero(~pivot), np.flatnonzero(pivot), np.zeros(len(nodes)), []
        rest = members if not len(pivots) else members[:0]
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                common = shared(at)
                near = (common >= min_similarity * (sizes[at] + sizes - common))[rest]
                if near.any():
                    pairs += [(at, x) for x in rest[near]]
                    queue += rest[near].tolist()
                    rest = rest[~near]
        for at in pivots:
            common = shared(at)
            union = sizes[at] + sizes - common
            score += common / np.maximum(union, 1)
            pairs += [(at, x) for x in members[(common >= min_similarity * union)[members]] if nodes[x] != nodes[at]]
        return _forest(np.array(pairs)) if pairs else [], score

    def take(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        keys, pivot, nodes = (rows.column(i).to_numpy() for i in range(3))
        lists = rows.column(3).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        cut = np.flatnonzero(np.diff(keys)) + 1
        a, b, scores = [], [], []
        for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])):
            pairs, score = group(nodes[lo:hi], pivot[lo:hi], np.diff(ends[lo : hi + 1]).astype(np.int64), flat[ends[lo] : ends[hi]])
            a += [nodes[lo + x] for x, _ in pairs]
            b += [nodes[lo + y] for _, y in pairs]
            scores += [None] * len(pairs)
            if pivot[lo:hi].any():
                who = np.flatnonzero(~pivot[lo:hi])
                a += nodes[lo + who].tolist()
                b += [None] * len(who)
                scores += score[who].tolist()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(scores, pa.float64())], names=["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from take([*held, batch.slice(0, cut)])
                held = []
            elif held and held[-1].column(0)[-1].as_py() != keys[0]:
                yield from take(held)
                held = []
            held.append(batch.slice(cut))
        yield from take(held)

    return run


def _similar(pairs: DataFrame, sets: DataFrame, min_similarity: float, where: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links a, b that connect whatever similar pairs connect within each component of the candidate ``pairs``.

    Members of a component meet in tasks of about ``group_rows``.  In a component of more, some
    members at a time are pivots, which meet all the others: four times as many each round, those
    first that were most similar to the pivots before.  A pair is left out only where both
    already have one root, so rounds end when all members that were no pivot have one.
    """
    groups = materialise(connected_components(pairs, f"{where}/groups").select("node", F.col("root").alias("comp")), f"{where}/members")
    large = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group_rows)
    large = materialise(large.select("comp", F.ceil(F.col("m") / group_rows).alias("chunks")), f"{where}/large")
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1)))
    dealt = groups.join(small_side(large, large.count(), 16), "comp", "left").select("comp", "node", chunk.alias("chunk"), "chunks")

    def meet(rows: DataFrame, name: str) -> DataFrame:
        keyed = rows.select(F.xxhash64("comp", "chunk").alias("key"), "pivot", "node").join(sets, "node").select("key", "pivot", "node", "shingles")
        return materialise(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_decide(min_similarity)), "a long, b long, score double"), f"{where}/{name}")

    links = meet(dealt.withColumn("pivot", F.lit(False)), "met").select("a", "b")
    if large.isEmpty():
        return links
    big = materialise(dealt.where("chunks IS NOT NULL"), f"{where}/big")
    joined = materialise(links.join(big.select(F.col("node").alias("a")), "a", "left_semi"), f"{where}/joined-0")
    state, turn, most = big.select("comp", "node", F.lit(0.0).alias("score"), F.lit(False).alias("done")), 0, FIRST_PIVOTS
    while True:
        roots = connected_components(joined, f"{where}/roots-{turn}")
        known = state.join(roots, "node", "left").withColumns({"root": F.coalesce("root", "node"), "score": F.col("score") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * 1e-12})
        shares = F.percentile_approx("score", [1 - 2.0**-j for j in range(1, 25)], 1_000_000)
        open_ = known.where("NOT done").groupBy("comp").agg(F.count_distinct("root").alias("roots"), F.count(F.lit(1)).alias("n"), shares.alias("q")).where("roots > 1")
        step = F.floor(F.log2(F.col("n") / most)).cast("int")
        limits = materialise(open_.select("comp", F.when(F.col("n") > 2 * most, F.element_at("q", F.least(step, F.lit(24)))).otherwise(F.lit(-1.0)).alias("limit")), f"{where}/limits-{turn}")
        if limits.isEmpty():
            return links.union(joined)
        live = materialise(known.join(limits, "comp", "left").select("comp", "node", "score", "done", F.col("limit").isNotNull().alias("live"), (~F.col("done") & F.coalesce(F.col("score") >= F.col("limit"), F.lit(False))).alias("pivot")), f"{where}/live-{turn}")
        members = big.join(live.where("live").select("node"), "node", "left_semi").select("comp", "chunk", "node", F.lit(False).alias("pivot"))
        pivots = live.where("pivot").select("comp", "node").join(large, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", F.lit(True).alias("pivot"))
        met = meet(members.union(pivots), f"met-{turn}")
        joined = materialise(joined.union(met.where("b IS NOT NULL").select("a", "b")), f"{where}/joined-{turn + 1}")
        scores = met.where("b IS NULL").select(F.col("a").alias("node"), F.col("score").alias("more"))
        state = materialise(live.join(scores, "node", "left").select("comp", "node", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("done") | F.col("pivot")).alias("done")), f"{where}/state-{turn}")
        turn, most = turn + 1, most * 4


def distinct_documents(docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Copies link if the Jaccard similarity of their shingle sets reaches ``min_similarity``.
    Candidates come from a 1,024-bit SimHash of the distinct shingles by operator 8's method: its
    512 segments of two bits are mapped to their bit counts, a cell holds who agrees on the counts
    of ten segments, and pairs that meet in a cell are filtered by the Manhattan distance of the
    counts of a 256-bit part, the lower bound, and verified on its bits.  At 0.8 about a sixth of
    the bits of two SimHashes differ, too many for any choice of cells that must hold every such
    pair; there are 153 kinds of cell, and the README gives their measured recall.  The decision
    is made on the shingles themselves, for whatever pairs the candidates connect.

    Texts without a word are copies of one another.  Rows equal in id and text are one.
    """
    spark, where = docs.sparkSession, work_dir(docs.sparkSession, "near-copies")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row"), text_or_empty(text_col).alias("text"))
    marked = materialise(_wide(source, shingle), f"{where}/wide")
    node = F.xxhash64("wide", "shingled")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    nodes = materialise(marked.groupBy(node.alias("node")).agg(least.alias("least"), F.any_value("wide").alias("wide"), F.count(F.lit(1)).alias("n")), f"{where}/nodes")

    sketch = [F.element_at("wide", i + 1).alias(f"s{i}") for i in range(SKETCH_WORDS)]
    celled = nodes.select("node", "wide").mapInArrow(tidy(_cells), "node long, wide array<long>, cells array<int>")
    grid = celled.select(F.explode("cells").alias("cell"), "node", *sketch).repartition("cell").sortWithinPartitions("cell")
    pairs = materialise(grid.mapInArrow(tidy(_link_wide), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{where}/pairs")

    # Decision on the shingle sets of one document for each shingle set that has a candidate.
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = materialise(nodes.join(asked, "node", "left_semi").select("node", "least.doc_id", "least.row"), f"{where}/chosen")
    side = small_side(chosen, chosen.count(), 48)
    texts = source.join(side, source["doc_id"].eqNullSafe(side["doc_id"]) & (source["row"] == side["row"])).select(side["node"], source["text"])
    sets = materialise(_shingle_sets(texts, shingle).dropDuplicates(["node"]), f"{where}/shingles")
    linked = _similar(pairs, sets, min_similarity, where)
    roots = connected_components(linked, f"{where}/components")

    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    keepers = materialise(placed.groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", "k.row"), f"{where}/keepers")
    side = small_side(keepers, keepers.count(), 48).withColumnsRenamed({"doc_id": "_k_id", "row": "_k_row"})
    (row,) = unused(docs, "_row")
    kept = docs.withColumn(row, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = kept.join(side, kept[id_col].eqNullSafe(side["_k_id"]) & (kept[row] == side["_k_row"]), "left_semi")
    repeated = marked.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates([id_col, row])).drop(row)
