"""Operator 4: personal data by weak supervision.

Base spans come from four fixed patterns and always stay.  Wider patterns propose further
candidates (obfuscated mail addresses, national phone numbers, other notations of IP
addresses and card numbers).  Four labelers vote for, against or not at all on every
candidate: pattern (is the notation strict?), gazetteer (known ending, area or country code,
issuer prefix), context (words that announce or rule out personal data nearby) and neighbours
(is it part of a longer token?).

The votes are counted by pattern of votes, a table bounded by the number of patterns and not
by the corpus.  Expectation-maximisation on those counts estimates how reliable each labeler
is in each class, with base spans held at certainty, and gives every pattern a probability.
A logistic classifier over the votes and the notation is then trained on these as soft labels
and decides which further candidates become spans.  Those that overlap a base span, or an
earlier accepted one, go.

Texts are read once; that pass writes candidates to the shared folder, and the later two
passes read only those.  All searches take time linear in the text, and overlaps are found by
bisection.

Cases: a null text counts as empty; null and repeated ids keep their rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_or_empty, work_dir
from .encoders import slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "neighbours")

# The base patterns' character classes and limits.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Gazetteers: fixed values.
ENDINGS = frozenset("com org net edu gov mil info biz io de fr es it uk us eu ch at nl be pl se no dk fi pt br mx ar ca au nz jp cn in ru".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "64", "81", "82", "86", "90", "91")
FOR = {
    "email": ("mail", "contact", "write", "reach", "schreib", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "client", "login"),
    "card": ("card", "visa", "master", "amex", "pay", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "sms", "whatsapp", "contact"),
}
AGAINST = ("isbn", "issn", "doi", "version", "invoice", "order", "page", "section", "figure", "table", "sku", "part no", "rfc")

_MORE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9./])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{1,2}[\x20-][0-9](?:[\x20-]?[0-9]){6,11}|0[1-9][0-9]{1,4}[/-][0-9](?:[\x20-]?[0-9]){4,9})(?![0-9])"),
}


#: Every match of the obfuscated mail pattern has one of each, in any case.
_AT = ("(at)", "[at]", "{at}", " at ")
_DOT = (".", "(dot)", "[dot]", "{dot}", " dot ")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the mail characters before it (no other @, nothing of an earlier match) and a domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four digit groups in a row; a failing match still uses up its groups."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        groups, at, i = run.group().split("."), run.start(), 0
        starts = []
        for g in groups:
            starts.append(at)
            at += len(g) + 1
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            if not all(four):
                i += 1
                continue
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in four):
                yield starts[i], starts[i + 3] + len(four[3])
            i += 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def more_candidates(text: str) -> list[tuple[int, int, int]]:
    out = []
    low = text.lower()
    if any(x in low for x in _AT) and any(x in low for x in _DOT):
        out += [(m.start(), 0, m.end()) for m in _MORE["email"].finditer(text)]
    if _DIGIT.search(text):
        if ":" in text or "[.]" in text:
            out += [(m.start(), 1, m.end()) for m in _MORE["ip"].finditer(text)]
        out += [(m.start(), 2, m.end()) for m in _MORE["card"].finditer(text)]
        out += [(m.start(), 3, m.end()) for m in _MORE["phone"].finditer(text)]
    return sorted(out)


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    strict = {"email": "(at)" in span.lower() or "[at]" in span.lower() or "{at}" in span.lower(), "ip": True, "card": bool(digits) and luhn(digits), "phone": span[0] in "(0" or "-" in span}[name]
    pattern = 1 if base or strict else -1
    if name == "email":
        gazetteer = 1 if re.split(r"[^a-z]+", span.lower().rstrip("])} "))[-1] in ENDINGS else -1
    elif name == "card":
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif name == "phone":
        national = digits[-10:]
        gazetteer = 1 if (span[0] == "+" or span[:2] == "00") and digits.lstrip("0").startswith(COUNTRIES) or len(national) == 10 and national[0] in "23456789" and national[3] in "23456789" else -1 if len(digits) == 10 else 0
    else:
        gazetteer = -1 if digits.strip("0") == "" else 0
    near = text[max(0, start - 48) : start].lower() + " " + text[end : end + 16].lower()
    context = 1 if any(w in near for w in FOR[name]) else -1 if any(w in near for w in AGAINST) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    neighbours = -1 if left.isalnum() or right.isalnum() else 1 if (not left or left.isspace() or left in "(<[:;,\"'") and (not right or right.isspace() or right in ".,;:)>]\"'!?") else 0
    return pattern, gazetteer, context, neighbours


def _feature(kind: int, base: bool, v: tuple[int, ...], span: str) -> int:
    """Kind, base, votes and notation (digits and separators, in four steps each) as one number."""
    n = sum(c in "0123456789" for c in span)
    marks = len({c for c in span if not c.isalnum()})
    code = kind * 2 + base
    for x in v:
        code = code * 3 + x + 1
    return (code * 4 + min(3, n // 5)) * 4 + min(3, marks)


def _unpack(code: int) -> tuple[int, bool, tuple[int, ...], int, int]:
    code, marks = divmod(code, 4)
    code, n = divmod(code, 4)
    v = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code // 2, bool(code % 2), tuple(v[::-1]), n, marks


def estimate(counts: dict[tuple, int], rounds: int = 60) -> tuple[dict[tuple, float], np.ndarray]:
    """Expectation-maximisation over patterns (kind, base, votes) with counts.

    Gives each pattern's probability of being personal data, and each labeler's table
    [class, vote] of vote probabilities.  Base patterns stay at 1.
    """
    keys = list(counts)
    if not keys:
        return {}, np.full((len(LABELERS), 2, 3), 1 / 3)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array([k[2] for k in keys]) + 1
    base = np.array([k[1] for k in keys])
    p = np.where(base, 1.0, 1 / (1 + np.exp(-(v - 1).sum(axis=1))))  # majority to begin with
    for _ in range(rounds):
        table = np.empty((len(LABELERS), 2, 3))
        for c, w in enumerate((n * (1 - p), n * p)):
            for x in range(3):
                table[:, c, x] = 1.0 + (w[:, None] * (v == x)).sum(axis=0)
        table /= table.sum(axis=2, keepdims=True)
        prior = (1 + (n * p)[~base].sum()) / (2 + n[~base].sum())
        score = np.log(prior / (1 - prior)) + sum(np.log(table[i, 1, v[:, i]] / table[i, 0, v[:, i]]) for i in range(len(LABELERS)))
        p = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
    return dict(zip(keys, p.tolist())), table


def _design(codes: list[int]) -> np.ndarray:
    rows = []
    for c in codes:
        kind, _, v, n, marks = _unpack(c)
        rows.append([1.0, *(float(kind == k) for k in range(4)), *(float(x == 1) for x in v), *(float(x == -1) for x in v), n / 3, marks / 3])
    return np.array(rows).reshape(len(codes), -1)


def train(counts: dict[int, int]) -> np.ndarray:
    """Weights of the span classifier from counts of feature codes: soft labels by ``estimate``, then Newton steps."""
    patterns: dict[tuple, int] = {}
    for code, n in counts.items():
        patterns[_unpack(code)[:3]] = patterns.get(_unpack(code)[:3], 0) + n
    labels, _ = estimate(patterns)
    codes = list(counts)
    if not codes:
        return np.zeros(5 + 2 * len(LABELERS) + 2)
    x = _design(codes)
    y, n = np.array([labels[_unpack(c)[:3]] for c in codes]), np.array([counts[c] for c in codes], dtype=float)
    n = n / n.sum() * 1000
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (n * (p - y)) + w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("feature", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("feature", pa.int32())]))


def _propose(id_type: pa.DataType):
    def rows(text: str, spans: list[tuple[int, int, int]], base: bool) -> list[dict]:
        return [{"start": a, "kind": k, "end": b, "feature": _feature(k, base, votes(text, a, k, b, base), text[a:b])} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch, 1024):
                base = [rows(t, base_spans(t), True) for t in texts]
                more = [rows(t, more_candidates(t), False) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(base, _ARROW_SPANS), pa.array(more, _ARROW_SPANS)], names=["doc_id", "base", "more"])

    return run


def _apart(spans: list[dict], base: list[dict]) -> list[dict]:
    """Those of ``spans`` that overlap neither a base span nor one taken before; both lists sorted by start."""
    starts, reach = [], []  # base spans by start, and how far they and all before them reach
    for s in base:
        starts.append(s["start"])
        reach.append(max(s["end"], reach[-1] if reach else 0))
    out, end = [], 0
    for s in spans:
        before = bisect.bisect_left(starts, s["end"])  # base spans that begin before this one ends
        if s["start"] >= end and (not before or reach[before - 1] <= s["start"]):
            out.append(s)
            end = s["end"]
    return out


def _decide(weights: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts: dict[int, bool] = {}
        for batch in batches:
            base, more = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for b, m in zip(base, more):
                for s in m:
                    if s["feature"] not in verdicts:
                        verdicts[s["feature"]] = float((_design([s["feature"]]) @ weights)[0]) > 0
                out.append(_apart([s for s in m if verdicts[s["feature"]]], b))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(1), pa.array(out, _ARROW_SPANS)], names=["doc_id", "base", "added"])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added: arrays of (start, kind, end, feature), code points, end exclusive, by start and kind."""
    from pyspark.sql.pandas.types import to_arrow_type

    where = work_dir(docs.sparkSession, "pii")
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("base", _SPANS), T.StructField("more", _SPANS)])
    proposed = materialise(source.mapInArrow(_propose(to_arrow_type(kind)), schema), f"{where}/proposed")
    # Bounded by the number of feature codes: 4 kinds, base or not, 3 votes of 4 labelers, 4 by 4 notations.
    codes = proposed.select(F.explode(F.concat("base.feature", "more.feature")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    weights = train({r["code"]: r["n"] for r in codes.collect()})
    decided = T.StructType([schema.fields[0], schema.fields[1], T.StructField("added", _SPANS)])
    return proposed.mapInArrow(_decide(weights, to_arrow_type(kind)), decided)
