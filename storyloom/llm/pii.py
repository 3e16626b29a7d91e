"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

Pattern matches are reported as they are. Other candidates (spelt-out addresses, numbers without a plus or with a bad
check digit, names after titles) are judged by a classifier: expectation-maximisation over all candidates' votes
estimates how reliable each labeler is, and a logistic model learns the resulting soft labels from votes and shape.
A candidate's votes and shape are one small code, so both are trained from the counts of all codes in the corpus.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import bounded, id_text, written
from storyloom.llm.textkernel import pieces

KINDS = ["email", "ip", "card", "phone", "name"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
BARE = re.compile(r"(?<![0-9+])[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+")
NAME = re.compile(r"[A-Z][\w'-]{1,30}(?: [A-Z][\w'-]{1,30})?")
#: Words of the labelers.
TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "my name is ", "My name is ")
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "it", "nl", "eu"}
GIVEN = {"James", "Mary", "John", "Anna", "Robert", "Maria", "Michael", "Laura", "David", "Sarah", "Peter", "Julia", "Thomas", "Emma", "Paul", "Lucia", "Jean", "Marie", "Hans", "Carlos"}
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|login|address|from", re.I),
    "card": re.compile(r"card|visa|credit|payment|account", re.I),
    "phone": re.compile(r"phone|call|\btel\b|fax|mobile|contact", re.I),
    "name": re.compile(r"name|dear|regards|signed", re.I),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans that the patterns hold, number runs that failed) as (kind, start, end)."""
    good, failed = [], []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            good.append((0, start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        (good if ok else failed).append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19:
                (good if _luhn(d) else failed).append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                good.append((3, m.start(), m.end()))
    return good, failed


def other_candidates(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "(dot)" in text or "[dot]" in text or " dot " in text:  # as every match holds
        out += [(0, m.start(), m.end()) for m in SPELT.finditer(text)]
    out += [(3, m.start() - (m.start() > 0 and text[m.start() - 1] == "(" and ")" in m[0]), m.end()) for m in BARE.finditer(text)]
    for title in TITLES:
        at = text.find(title)
        while at >= 0:
            if m := NAME.match(text, at + len(title)):
                out.append((4, m.start(), m.end()))
            at = text.find(title, at + len(title))
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int, int, int]:
    """The votes (-1, 0, 1) of the regex, gazetteer and context labelers, and three bits of shape."""
    s, before = text[start:end], text[max(0, start - 40) : start]
    digits, name = _digits(s), KINDS[kind]
    regex = 1 if strict else -1 if kind in (1, 2) else 0
    if kind == 0:
        listed = 1 if re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in TOP_DOMAINS else -1
    elif kind == 1:
        listed = -1 if s.split(".")[0] in ("0", "10", "127", "255") or s.startswith("192.168.") else 1
    elif kind == 2:
        listed = 1 if digits[0] in "3456" and len(digits) in (13, 15, 16) else -1
    elif kind == 3:
        listed = 1 if digits[0] != "0" and len(digits) in (10, 11, 12) else -1
    else:
        listed = 1 if s.split(" ")[0] in GIVEN else 0
    context = 1 if CONTEXT[name].search(before) else 0
    shape = (any(c in " -.()" for c in s)) | (bool(before) and before[-1].isalnum()) << 1 | (end < len(text) and text[end].isalnum()) << 2
    return regex, listed, context, int(shape)


def code_of(kind: int, v: tuple[int, int, int, int]) -> int:
    return (((kind * 3 + v[0] + 1) * 3 + v[1] + 1) * 3 + v[2] + 1) * 8 + v[3]


CODES = len(KINDS) * 27 * 8


def _parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, votes (n, 3) and shape of codes."""
    v, shape = codes // 8, codes % 8
    return v // 27, np.stack([v // 9 % 3 - 1, v // 3 % 3 - 1, v % 3 - 1], axis=1), shape


def reliabilities(counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(P(vote | personal or not) by kind, labeler, class and vote; each code's posterior) by expectation-maximisation."""
    codes = np.arange(CODES)
    kind, v, _ = _parts(codes)
    post = 1 / (1 + np.exp(-(1.5 * v[:, 0] + v[:, 1] + v[:, 2])))
    table = np.zeros((len(KINDS), 3, 2, 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            for j in range(3):
                for c in (0, 1):
                    w = counts * (post if c else 1 - post) * (kind == k)
                    # a labeler is taken to be right more often than wrong: 4 imagined votes against 1
                    prior = np.array([4.0, 2.0, 1.0]) if c == 0 else np.array([1.0, 2.0, 4.0])
                    n = np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + prior
                    table[k, j, c] = n / n.sum()
        share = np.array([((counts * post)[kind == k].sum() + 1) / (counts[kind == k].sum() + 2) for k in range(len(KINDS))])
        like = [np.log(np.where(c, share, 1 - share))[kind] + sum(np.log(table[kind, j, c, v[:, j] + 1]) for j in range(3)) for c in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return table, post


def _features(codes: np.ndarray) -> np.ndarray:
    kind, v, shape = _parts(codes)
    one = np.eye(len(KINDS))[kind]
    bits = np.stack([shape & 1, shape >> 1 & 1, shape >> 2 & 1], axis=1)
    return np.concatenate([one, v, v == 0, bits, (one[:, :, None] * v[:, None, :]).reshape(len(codes), -1)], axis=1).astype(float)


def train(counts: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """The classifier's probability for each code: a logistic model of soft labels, weighted by the codes' counts."""
    _, post = reliabilities(counts)
    x = _features(np.arange(CODES))
    w = np.zeros(x.shape[1])
    scale = counts / max(1.0, counts.sum()) * min(counts.sum(), 10_000)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (scale * (post - p)) - ridge * w
        h = (x * (scale * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, g)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def find_pii(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (spans by pattern), base_sha256, spans (all, as kind:start:end).

    Spans are code point offsets, by kind, then start, comma-joined. A candidate of the classifier is left out where it
    overlaps a pattern's span. A null or empty text has no spans; repeated rows and null keys stay; extra columns are left behind.
    """
    spark = docs.sparkSession
    bounded(spark)
    kind_list = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32())]))

    def look(batches):
        for b in pieces(batches, "text"):
            base, other, codes = [], [], []
            for text in b.column("text").to_pylist():
                good, failed = base_spans(text)
                good.sort()
                more = [(k, s, e) for k, s, e in failed + other_candidates(text) if not any(x[1] < e and s < x[2] for x in good)]
                base.append(good)
                codes.append([code_of(k, votes(text, k, s, e, True)) for k, s, e in good])
                other.append([{"kind": k, "start": s, "end": e, "code": code_of(k, votes(text, k, s, e, k == 4))} for k, s, e in sorted(set(more))])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "base": pa.array([",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in x) for x in base]),
                    **{f"n_{n}": pa.array([sum(k == i for k, _, _ in x) for x in base], pa.int64()) for i, n in enumerate(KINDS[:4])},
                    "other": pa.array(other, kind_list),
                    "codes": pa.array([c + [o["code"] for o in x] for c, x in zip(codes, other)], pa.list_(pa.int32())),
                }
            )

    schema = "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, other array<struct<kind:int,start:long,end:long,code:int>>, codes array<int>"
    seen = written(id_text(docs, id_col, text_col).mapInArrow(look, schema))
    counts = np.zeros(CODES)
    for r in seen.select(F.explode("codes").alias("c")).groupBy("c").count().collect():  # at most CODES rows
        counts[r["c"]] = r["count"]
    accepted = {int(c) for c in np.flatnonzero(train(counts) >= least)}

    def judge(batches):
        for b in batches:
            all_spans = []
            for base, other in zip(b.column("base").to_pylist(), b.column("other").to_pylist()):
                if extra := [f"{KINDS[o['kind']]}:{o['start']}:{o['end']}" for o in other if o["code"] in accepted]:
                    spans = [x.split(":") for x in [*filter(None, base.split(",")), *extra]]
                    base = ",".join(":".join(x) for x in sorted(spans, key=lambda x: (KINDS.index(x[0]), int(x[1]), int(x[2]))))
                all_spans.append(base)
            cols = {n: b.column(n) for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")}
            yield pa.RecordBatch.from_pydict(cols | {"base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in b.column("base").to_pylist()]), "spans": pa.array(all_spans, pa.string())})

    return seen.mapInArrow(judge, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
