"""Personal data: fixed patterns, and further spans by weak supervision.

Emails, IP addresses, card and phone numbers are found by pattern and always stay. Every other run of letters
and digits with a digit in it is a candidate. Labelers vote on candidates (+1, -1 or 0 for no opinion): by
regular expression on the shape, by gazetteers of key prefixes and of words around, and by context. Votes are
counted per pattern of votes over all documents; expectation-maximisation on those counts estimates the share
of personal data and each labeler's reliability. The resulting probabilities train a logistic span classifier on
measured features, and it decides on each candidate: what it takes and no fixed pattern overlaps is a
``secret``.

The classifier is fitted on at most ``fit_spans`` candidates, chosen by a hash of the document's id and place, and
as many vote patterns as labelers can give (3 ** 6); everything else covers all rows and whole texts.

Defined cases: null and empty texts have no spans; equal rows are judged alike; without candidates there
are no secrets; an empty table gives no rows; other columns are passed on or not read. Offsets are
code points, ends exclusive; at one start the order is email, ip, card, phone, secret.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import drawn, settle, small_batches, tidy

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"[A-Za-z0-9_+/-]+")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")

#: Words of the gazetteers.
TELLING = frozenset(
    "password passwd pwd pass passphrase token secret key apikey api_key auth bearer credential credentials ssn "
    "passport iban account login pin".split()
)
HARMLESS = frozenset(
    "version chapter section page figure fig table volume vol no number license part step level item line rev".split()
)
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk-", "xoxb-", "xoxp-", "AIza", "ya29")
LABELERS = ("shape", "hex", "key_start", "word_before", "assigned", "variety")
FEATURES = 12
LEFT = re.compile(r"([\w]+)[\W]{0,4}$")
ASSIGNED = re.compile(r"[=:]\s?[\"']?$")
HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``EMAIL``, looked for around each at sign."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    first = DIGIT.search(text)
    if first:
        begin = first.start()
        for m in IP.finditer(text, begin):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, begin):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text, max(begin - 1, 0)):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of letters and digits that hold a digit."""
    found = DIGIT.search(text)
    end = 0
    while found:
        start = found.start()
        while start > end and text[start - 1] in RUN_CHARS:
            start -= 1
        end = RUN.match(text, start).end()
        yield start, end
        found = DIGIT.search(text, end)


def judged(text: str, start: int, end: int) -> tuple[str, list[float]]:
    """The labelers' votes on a candidate, one character each, and its features."""
    run = text[start:end]
    before = text[max(start - 24, 0) : start]
    n = len(run)
    digits = sum(c in "0123456789" for c in run)
    upper = sum("A" <= c <= "Z" for c in run)
    lower = sum("a" <= c <= "z" for c in run)
    kinds = len(set(run))
    left = LEFT.search(before)
    word = left.group(1).lower() if left else ""
    assigned = bool(ASSIGNED.search(before))
    starts = run.startswith(KEY_STARTS)
    is_hex = bool(HEX.fullmatch(run))
    votes = (
        1 if n >= 16 and upper + lower and digits else -1 if n < 8 else 0,
        1 if is_hex else 0,
        1 if starts and n >= 16 else 0,
        1 if word in TELLING else -1 if word in HARMLESS else 0,
        1 if assigned else -1 if n < 8 else 0,
        1 if kinds >= 10 else -1 if kinds <= 4 else 0,
    )
    features = [
        min(n, 64) / 32,
        digits / n,
        upper / n,
        lower / n,
        kinds / 16,
        float(upper + lower > 0 and n >= 16),
        float(is_hex),
        float(starts),
        float(word in TELLING),
        float(word in HARMLESS),
        float(assigned),
        float(n < 8),
    ]
    return "".join("-0+"[v + 1] for v in votes), features


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and candidates (start, end, votes, features) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found_type = pa.list_(
        pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("x", pa.list_(pa.float64()))]
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            base, found = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text or "")
                taken = Taken(own)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                found.append(
                    [
                        {"start": a, "end": b, "votes": v, "x": x}
                        for a, b in candidates(text or "")
                        if not taken.overlaps(a, b)
                        for v, x in [judged(text, a, b)]
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "base", "found"]
            )

    schema = (
        f"doc_id {kind}, base array<struct<start:bigint,kind:int,end:bigint>>, "
        "found array<struct<start:bigint,end:bigint,votes:string,x:array<double>>>"
    )
    return rows.mapInArrow(tidy(scan), schema)


class Taken:
    """Whether any of the sorted spans shares a place with a run."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self._starts = [a for a, _, _ in spans]
        self._ends = list(accumulate([b for _, _, b in spans], max))

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect_left(self._starts, end)
        return before > 0 and self._ends[before - 1] > start


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(probability of personal data per vote pattern, reliability table per labeler) by EM.

    A labeler's table holds how often it votes -, 0 and + on either class, smoothed; majority votes start it.
    """
    votes = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), len(LABELERS))
    p = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    prior = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # a vote is more often right than wrong
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        share = (np.array([(counts * (1 - p)).sum(), (counts * p).sum()]) + 1) / (counts.sum() + 2)
        score = np.log(share)[None].repeat(len(patterns), 0)
        for k in range(len(LABELERS)):
            for y, weight in ((0, counts * (1 - p)), (1, counts * p)):
                seen = np.bincount(votes[:, k], weight, 3) + prior[y]
                table[k, y] = seen / seen.sum()
            score += np.log(table[k][:, votes[:, k]]).T
        p = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
    return p, table


def classifier(x: np.ndarray, p: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights and bias of a ridge logistic regression on probabilistic labels, by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    theta = np.zeros(a.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (q - p) + theta
        bend = (a * (q * (1 - q))[:, None]).T @ a + np.eye(len(theta))
        theta -= np.linalg.solve(bend, grad)
    return theta


def learned(found: DataFrame, fit_spans: int = 20_000) -> list[float]:
    """Weights of the span classifier from scanned documents (a written table)."""
    every = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.start", "c.votes", "c.x")
    counted = every.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    if not counted:
        return [0.0] * FEATURES + [-math.inf]
    patterns = [r.votes for r in counted]
    p, _ = reliabilities(patterns, np.array([r.n for r in counted], float))
    # only spans below the cut leave their tasks; repeated rows, whose lots are equal, stay within the limit
    few = drawn(every.withColumn("lot", F.xxhash64("doc_id", "start")), "lot", fit_spans)
    rows = few.orderBy("lot", "doc_id", "start", "votes").limit(fit_spans).select("votes", "x").toPandas()
    known = dict(zip(patterns, p, strict=True))
    return classifier(np.array(rows["x"].tolist()), rows["votes"].map(known).to_numpy(float)).tolist()


def _takes(weights: list[float], x: Column) -> Column:
    """Whether the classifier gives one half or more."""
    if weights[-1] == -math.inf:
        return F.lit(False)
    parts = F.zip_with(x, F.array(*[F.lit(w) for w in weights[:-1]]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(weights[-1]), lambda s, v: s + v) >= 0


def _told(spans: Column) -> Column:
    """``kind:start:end`` of sorted (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def digests(found: DataFrame, weights: list[float]) -> DataFrame:
    """doc_id, counts of the fixed patterns, the hash of their list, and all spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    taken = F.transform(
        F.filter("found", lambda c: _takes(weights, c["x"])),
        lambda c: F.struct(c["start"].alias("start"), F.lit(SECRET).alias("kind"), c["end"].alias("end")),
    )
    return found.select(
        "doc_id",
        *[count(k) for k in range(SECRET)],
        F.sha2(_told(F.sort_array("base")), 256).alias("base_sha256"),
        _told(F.sort_array(F.concat("base", taken))).alias("spans"),
    )


def masked_text(text: str, weights: list[float]) -> str:
    """A text with every span replaced by its kind in brackets; overlapping spans by that of the first."""
    spans = base_spans(text)
    fixed, secrets = Taken(spans), []
    if weights[-1] > -math.inf:
        for a, b in candidates(text):
            if not fixed.overlaps(a, b):
                score = weights[-1]
                for v, w in zip(judged(text, a, b)[1], weights, strict=False):
                    score += v * w
                if score >= 0:
                    secrets.append((a, SECRET, b))
    out, at = [], 0
    for start, kind, end in sorted(spans + secrets):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def masked(docs: DataFrame, weights: list[float], text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with spans masked in the text, and its length where that column is there; null stays null."""
    at = docs.columns.index(text_col)
    long = docs.columns.index(length_col) if length_col in docs.columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            texts = [None if t is None else masked_text(t, weights) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if long is not None:
                sizes = [None if t is None else len(t) for t in texts]
                columns[long] = pa.array(sizes, pa.int64()).cast(batch.schema.field(long).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(tidy(mask), docs.schema)


def found_in(docs: DataFrame, **columns: str) -> tuple[DataFrame, list[float]]:
    """(scanned documents in the shared folder, classifier weights); texts are read once."""
    found = settle(scanned(docs, **columns), "spans")
    return found, learned(found)
