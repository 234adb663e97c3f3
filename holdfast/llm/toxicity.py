"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document, so tokens are labelled first: word and word-start types are counted by their
distinct neighbourhoods (copies of a document add none), and types whose neighbourhoods lie in toxic
documents more than chance allows mark their tokens there. The field has the states clean and toxic, emission
weights for a token's word and word starts, and transitions; it is fitted in numpy by Adam on the exact
gradient from forward-backward. Applied to whole texts, forward-backward runs over all tokens of a batch as a
scan of 2 x 2 matrices. A document's score is the noisy-or of its tokens' marginals of at least
``FLOOR`` (their greatest if none is), its offsets are the runs of tokens with a marginal of one half or more.

The fit takes at most ``fit_toxic`` and ``fit_clean`` labelled rows that are there, of any length, chosen by a hash
of their id. Of a text with more than ``fit_segments`` segments of ``SEGMENT`` tokens it takes so many, evenly spread
from its first to its last and cut in the executors, where types and neighbourhoods are counted too; the driver gets
the types that pass and at most ``segments`` segments with and as many without marked tokens. Everything else covers
all rows and whole texts.

Defined cases: null and empty texts score 0; a row without an id is scored but not learned from; of several
labels for one id the greatest counts; without toxic or without clean rows to learn from all scores
are 0; equal rows score alike; an empty table gives no rows; other columns are passed on or not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import drawn, settle, small_batches, tidy

TOKEN = re.compile(r"\w+")
STARTS = (4, 5, 6)
FLOOR = 0.05
SEGMENT = 48
MOST_WORDS = 400_000
LONGEST_KEPT = 64


def _types(word: str) -> list[str]:
    """The features of a token: its word and its first letters."""
    return [word, *[word[:k] + "*" for k in STARTS if len(word) > k]]


#: Token lists of a text; tokens of different lists do not stand side by side.
Runs = list[list[str]]


def spread(tokens: list[str], most: int) -> Runs:
    """All tokens as one run; of more than ``most`` segments so many, evenly spread, with neighbours as one run."""
    count = -(-len(tokens) // SEGMENT)
    if count <= most:
        return [tokens]
    kept = np.unique(np.linspace(0, count - 1, most).round().astype(np.int64))
    ends = np.append(np.flatnonzero(np.diff(kept) > 1), len(kept) - 1)
    firsts = np.concatenate([[0], ends[:-1] + 1])
    return [tokens[kept[i] * SEGMENT : (kept[j] + 1) * SEGMENT] for i, j in zip(firsts, ends, strict=True)]


def learning_rows(
    docs: DataFrame,
    labels: DataFrame,
    fit_toxic: int,
    fit_clean: int,
    fit_segments: int,
    learn: F.Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(lot, toxic, runs): tokens and label of the rows to learn from, written to the shared folder.

    The chosen labels are bounded by the parameters and so broadcast.
    """
    bounds = ((1, fit_toxic), (0, fit_clean))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    one = one.where(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # only labels of documents that have a text to learn from are drawn
    one = one.join(rows.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    lot = F.xxhash64("doc_id", F.lit("toxicity"))
    parts = [one.where(F.col("toxic") == k).orderBy(lot, "doc_id").limit(n) for k, n in bounds]
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "_label_id")
    found = rows.where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most_bytes=4 << 20):
            runs = [spread(TOKEN.findall(t.lower()), fit_segments) for t in batch.column(0).to_pylist()]
            column = pa.array(runs, pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([column, *batch.columns[1:]], ["runs", "toxic", "lot"])

    found = found.select("text", "toxic", F.xxhash64("doc_id", "text").alias("lot"))
    cuts = settle(found.mapInArrow(tidy(cut), "runs array<array<string>>, toxic int, lot long"), "toxicity-cuts")
    # the rows of an id may be many, equal ones among them; of equal rows one is learned from
    lots = cuts.select("toxic", "lot").distinct()
    lots = [drawn(lots.where(F.col("toxic") == k), "lot", n) for k, n in bounds]
    few = F.broadcast(lots[0].unionByName(lots[1]))
    return settle(cuts.join(few, ["toxic", "lot"]).dropDuplicates(["toxic", "lot"]), "toxicity-rows")


def marked_types(rows: DataFrame) -> set[str]:
    """``toxic_types`` of the rows to learn from: all counting is done by aggregates, and only types that pass leave them."""
    sizes = rows.groupBy("toxic").agg(F.sum(F.aggregate("runs", F.lit(0), lambda n, r: n + F.size(r))).alias("n"))
    sizes = {r.toxic: r.n or 0 for r in sizes.collect()}
    if not sizes.get(0) or not sizes.get(1):
        return set()
    share = sizes[1] / (sizes[0] + sizes[1])

    def around(word, k):
        left, right = (F.coalesce(F.get("run", k + step), F.lit("")) for step in (-1, 1))
        return F.struct(word.alias("word"), F.xxhash64(left, right).alias("near"))

    tokens = rows.select("lot", "toxic", F.explode("runs").alias("run"))
    tokens = tokens.select("lot", "toxic", F.explode(F.transform("run", around)).alias("t")).select("lot", "toxic", "t.*")
    starts = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STARTS]
    typed = F.explode(F.array_compact(F.array("word", *starts))).alias("type")
    seen = tokens.groupBy("word", "near").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    stats = seen.select(typed, "near", "n1", "n0").groupBy("type", "near").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    stats = stats.groupBy("type").agg(
        F.sum("n1").alias("n"),
        F.count(F.when(F.col("n1") > 0, 1)).alias("yes"),
        F.count(F.when(F.col("n0") > 0, 1)).alias("no"),
    )
    stats = settle(stats.where("n > 0"), "toxicity-types")
    enough = math.log(100 * stats.count())
    # even if none of a type were in clean texts, so many would be needed
    stats = stats.where(F.col("n") >= enough / -math.log(share))
    words = tokens.where("toxic = 1").select("lot", "word").distinct()
    texts = words.select("lot", typed).distinct().groupBy("type").agg(F.count(F.lit(1)).alias("texts"))
    under = words.select("word").distinct().select("word", F.explode(F.array_compact(F.array(*starts))).alias("type"))
    of_word = stats.select(F.col("type").alias("word"), F.col("yes").alias("word_yes"))
    under = under.join(of_word, "word", "left").groupBy("type").agg(
        F.count(F.lit(1)).alias("words"), F.max(F.coalesce("word_yes", F.lit(0))).alias("most")
    )
    # long toxic texts among short clean ones make any type's part large
    often = F.col("yes") / (F.col("yes") + F.col("no")) > max(0.9, share)
    found = stats.where(often).join(texts, "type").where("2 * yes >= texts").join(under, "type", "left")
    found = found.where("words is null or (words >= 3 and 2 * most <= yes)").select("type", "yes", "no")
    return {r.type for r in found.collect() if _surprise(r.yes, r.no, share) >= enough}


def _surprise(yes: int, no: int, share: float) -> float:
    """How far a type's neighbourhoods lie from chance, as a log-likelihood."""
    part = yes / (yes + no)
    return yes * math.log(part / share) + (no * math.log((1 - part) / (1 - share)) if no else 0.0)


def marked_pieces(rows: DataFrame, marks: set[str], segments: int) -> list[tuple[bool, list[str]]]:
    """(has a marked token, tokens) of segments to learn from: of each kind at most ``segments``, by a hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lots, hits, parts = [], [], []
            for lot, toxic, runs in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                own = [r[k : k + SEGMENT] for r in runs for k in range(0, len(r), SEGMENT)]
                lots += [f"{lot} {k}" for k in range(len(own))]
                hits += [bool(toxic) and any(t in marks for w in part for t in _types(w)) for part in own]
                parts += [" ".join(part) for part in own]
            arrays = [pa.array(lots, pa.string()), pa.array(hits, pa.bool_()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["lot", "hit", "part"])

    pieces = rows.select("lot", "toxic", "runs").mapInArrow(tidy(cut), "lot string, hit boolean, part string")
    pieces = settle(pieces.withColumn("lot", F.xxhash64("lot")), "toxicity-pieces")
    kinds = [drawn(pieces.where(F.col("hit") == hit), "lot", segments).orderBy("lot", "part") for hit in (True, False)]
    same: dict[str, str] = {}  # one object per word, not per token
    return [
        (r.hit, [same.setdefault(w, w) for w in r.part.split()])
        for kind in kinds
        for r in kind.select("hit", "part").toLocalIterator()
    ]


def toxic_types(words: list[Runs], toxic: np.ndarray) -> set[str]:
    """Types whose distinct neighbourhoods lie in toxic texts too often for chance.

    A word start counts as a type of its own only if it is the start of several such words' worth of text:
    of at least three different words, none with half of its neighbourhoods.
    """
    counts: dict[str, int] = defaultdict(int)
    sizes = [0, 0]
    for runs, label in zip(words, toxic, strict=True):
        sizes[label] += sum(map(len, runs))
        if label:
            for tokens in runs:
                for word in tokens:
                    for t in _types(word):
                        counts[t] += 1
    if not sizes[0] or not sizes[1]:
        return set()
    share = sizes[1] / (sizes[0] + sizes[1])
    enough = math.log(100 * len(counts))
    # even if none of a type were in clean texts, so many would be needed
    least = enough / -math.log(share)
    counts = {t: n for t, n in counts.items() if n >= least}
    around: tuple[dict, dict] = defaultdict(set), defaultdict(set)
    texts: dict[str, int] = defaultdict(int)
    under: dict[str, set[str]] = defaultdict(set)
    for runs, label in zip(words, toxic, strict=True):
        seen = set()
        for tokens in runs:
            for k, word in enumerate(tokens):
                near = None
                for t in _types(word):
                    if t in counts:
                        near = near or hash((tokens[k - 1] if k else "", tokens[k + 1] if k + 1 < len(tokens) else ""))
                        around[label][t].add(near)
                        seen.add(t)
        if label:
            for t in seen:
                texts[t] += 1
            for word in set().union(*runs):
                for t in _types(word)[1:]:
                    if t in counts:
                        under[t].add(word)
    found = set()
    for t, near in around[1].items():
        yes, no = len(near), len(around[0].get(t, ()))
        part = yes / (yes + no)
        # long toxic texts among short clean ones make any type's part large
        if part <= max(0.9, share) or 2 * yes < texts[t]:
            continue
        own = under.get(t)
        if own is not None and (len(own) < 3 or 2 * max(len(around[1].get(w, ())) for w in own) > yes):
            continue
        if _surprise(yes, no, share) >= enough:
            found.add(t)
    return found


class Field:
    """Emission weights by type, transitions between the two states, and what they give for texts."""

    def __init__(self, weights: dict[str, float], bias: float, start: np.ndarray, moves: np.ndarray):
        self.weights, self.bias, self.start, self.moves = weights, bias, start, moves
        self._odds: dict[str, float] = {}

    def _odd(self, word: str) -> float:
        """Log-odds of toxic that a token itself gives."""
        known = self._odds.get(word)
        if known is None:
            get = self.weights.get
            known = self.bias + sum([get(t, 0.0) for t in _types(word.lower())])
            if len(self._odds) < MOST_WORDS and len(word) <= LONGEST_KEPT:
                self._odds[word] = known
        return known

    def marginals(self, words: list[list[str]]) -> list[np.ndarray]:
        """Probability of toxic for each token of each text."""
        sizes = np.array([len(w) for w in words], np.int64)
        total = int(sizes.sum())
        if not total or not self.weights:
            return [np.zeros(n) for n in sizes]
        odd = self._odd
        emit = np.exp(np.clip(np.fromiter((odd(w) for ws in words for w in ws), float, total), -30, 30))
        first = np.zeros(total, bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        p = chain(emit, first, np.exp(self.start), np.exp(self.moves))
        return np.split(p, ends[:-1])


def chain(emit: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, block: int = 256) -> np.ndarray:
    """Marginals of state 1 in one long chain that begins anew wherever ``first`` holds.

    Step ``t`` multiplies by ``[[m00, m01 e], [m10, m11 e]]``; where a text begins both rows are the start's,
    which forgets what came before. Blocks of steps are multiplied side by side, blocks are scanned, and a
    second pass inside the blocks gives both directions.
    """
    n = len(emit)
    width = -(-n // block)
    m = np.zeros((2, 2, width * block))
    m[0, 0] = m[1, 1] = 1.0
    for i in (0, 1):
        for j in (0, 1):
            step = np.where(first, start[j], moves[i, j])
            m[i, j, :n] = step * emit if j else step
    m = np.ascontiguousarray(m.reshape(2, 2, width, block).transpose(3, 0, 1, 2))  # step, row, column, block
    product = m[0].copy()
    for t in range(1, block):
        product = np.einsum("ijk,jlk->ilk", product, m[t])
        product /= product.sum(axis=(0, 1))
    ahead = np.empty((2, width))
    state = np.array([0.5, 0.5])
    for k in range(width):
        ahead[:, k] = state
        state = state @ product[:, :, k]
        state /= state.sum()
    behind = np.empty((2, width))
    state = np.array([0.5, 0.5])
    for k in range(width - 1, -1, -1):
        behind[:, k] = state
        state = product[:, :, k] @ state
        state /= state.sum()
    forward = np.empty((block, 2, width))
    for t in range(block):
        ahead = np.stack([ahead[0] * m[t, 0, j] + ahead[1] * m[t, 1, j] for j in (0, 1)])
        ahead /= ahead.sum(axis=0)
        forward[t] = ahead
    p = np.empty((block, width))
    for t in range(block - 1, -1, -1):
        both = forward[t] * behind
        p[t] = both[1] / both.sum(axis=0)
        behind = np.stack([m[t, i, 0] * behind[0] + m[t, i, 1] * behind[1] for i in (0, 1)])
        behind /= behind.sum(axis=0)
    return p.T.ravel()[:n]


def fit(texts: list[str], toxic: np.ndarray, segments: int = 12_000, steps: int = 40) -> Field:
    """A field for labelled texts; with only one label present, one that finds nothing."""
    return fit_runs([[TOKEN.findall((t or "").lower())] for t in texts], toxic, segments, steps)


def fit_runs(words: list[Runs], toxic: np.ndarray, segments: int = 12_000, steps: int = 40) -> Field:
    """``fit`` on the tokens of labelled texts."""
    marks = toxic_types(words, toxic)
    pieces = []  # (has toxic tokens, words)
    for runs, label in zip(words, toxic, strict=True):
        parts = [tokens[k : k + SEGMENT] for tokens in runs for k in range(0, len(tokens), SEGMENT)]
        pieces += [(bool(label) and any(t in marks for w in part for t in _types(w)), part) for part in parts]
    # segments of all rows, with and without toxic tokens, have the same chance
    lots = np.random.default_rng(0)
    spare, marked = [p for p in pieces if not p[0]], [p for p in pieces if p[0]]
    chosen = [[some[i] for i in np.sort(lots.permutation(len(some))[:segments])] for some in (marked, spare)]
    return fit_pieces(chosen[0] + chosen[1], marks, steps)


def fit_pieces(pieces: list[tuple[bool, list[str]]], marks: set[str], steps: int = 40) -> Field:
    """A field for segments; the marked types mark their tokens in the segments of toxic texts."""
    if not marks:
        return Field({}, 0.0, np.zeros(2), np.zeros((2, 2)))
    counts: dict[str, int] = defaultdict(int)
    for _, part in pieces:
        for w in part:
            for t in _types(w):
                counts[t] += 1
    used = sorted(t for t, n in counts.items() if n >= 5 and (t in marks or not t.endswith("*")))
    index = {t: i + 1 for i, t in enumerate(used)}
    width = 1 + len(STARTS)
    x = np.zeros((SEGMENT, len(pieces), width), np.int32)
    y = np.zeros((SEGMENT, len(pieces)), np.int64)
    real = np.zeros((SEGMENT, len(pieces)), bool)
    for j, (hit, part) in enumerate(pieces):
        for i, w in enumerate(part):
            types = _types(w)
            for f, t in enumerate(types):
                x[i, j, f] = index.get(t, 0)
            y[i, j] = hit and any(t in marks for t in types)
        real[: len(part), j] = True
    theta = np.zeros(len(index) + 1 + 1 + 2 + 4)  # type weights (0: none), bias, start, moves
    size = len(index) + 1
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = _gradient(theta, size, x, y, real) + 1e-4 * theta * real.sum() / 1000
        grad[0] = 0
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = {t: float(theta[i]) for t, i in index.items() if abs(theta[i]) > 1e-6}
    return Field(weights, float(theta[size]), theta[size + 1 : size + 3], theta[size + 3 :].reshape(2, 2))


def _gradient(theta: np.ndarray, size: int, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Gradient of the negative log-likelihood over segments, by forward-backward in step with each other."""
    steps, count, _ = x.shape
    emit = theta[x].sum(axis=2) + theta[size]
    start, moves = theta[size + 1 : size + 3], theta[size + 3 :].reshape(2, 2)
    hot = np.exp(moves)
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))])  # state, step, segment
    forward = np.empty((steps, 2, count))
    a = np.exp(start)[:, None] * e[:, 0]
    forward[0] = a / a.sum(axis=0)
    for t in range(1, steps):
        a = (hot.T @ forward[t - 1]) * e[:, t]
        a = np.where(real[t], a / a.sum(axis=0), forward[t - 1])
        forward[t] = a
    grad = np.zeros_like(theta)
    p = np.empty((steps, count))
    b = np.ones((2, count))
    moved = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        both = forward[t] * b
        p[t] = both[1] / both.sum(axis=0)
        if t:
            joint = forward[t - 1][:, None] * hot[:, :, None] * (e[:, t] * b)[None]
            joint /= joint.sum(axis=(0, 1))
            moved += (joint * real[t]).sum(axis=2)
            back = hot @ (e[:, t] * b)
            b = np.where(real[t], back / back.sum(axis=0), b)
    for i in (0, 1):
        for j in (0, 1):
            moved[i, j] -= float(((y[:-1] == i) & (y[1:] == j) & real[1:]).sum())
    grad[size + 3 :] = moved.ravel()
    off = (p - y) * real
    grad[size + 2] = off[0].sum()
    grad[size + 1] = -grad[size + 2]
    grad[size] = off.sum()
    for f in range(x.shape[2]):
        grad[:size] += np.bincount(x[:, :, f].ravel(), off.ravel(), size)
    return grad


def score_of(p: np.ndarray) -> float:
    """Noisy-or of the marginals that matter."""
    strong = p[p >= FLOOR]
    if len(strong):
        return float(1.0 - np.exp(np.log1p(-np.minimum(strong, 1 - 1e-12)).sum()))
    return float(p.max(initial=0.0))


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in code points of the runs of tokens with a marginal of one half or more."""
    out: list[tuple[int, int]] = []
    last = -2
    for k, token in enumerate(TOKEN.finditer(text)):
        if p[k] >= 0.5:
            if k == last + 1:
                out[-1] = (out[-1][0], token.end())
            else:
                out.append((token.start(), token.end()))
            last = k
    return out


def _judged(field: Field, texts: list[str | None]) -> tuple[list[float], list[str]]:
    """(scores, offsets as start:end, comma-joined) of whole texts."""
    marginals = field.marginals([TOKEN.findall(t or "") for t in texts])
    scores = [score_of(p) for p in marginals]
    spans = [
        ",".join(f"{a}:{b}" for a, b in spans_of(t, p)) if len(p) and p.max() >= 0.5 else ""
        for t, p in zip(texts, marginals, strict=True)
    ]
    return scores, spans


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and spans of every row; a projection without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.bias, field.start, field.moves))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in small_batches(batches, most_bytes=4 << 20):
            scores, spans = _judged(own, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", "score", "predicted", "spans"],
            )

    return rows.mapInArrow(tidy(judge), f"doc_id {kind}, score double, predicted int, spans string")


def accepted(docs: DataFrame, field: Field, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``most``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.bias, field.start, field.moves))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in small_batches(batches, text_col, most_bytes=4 << 20):
            scores, _ = _judged(own, batch.column(at).to_pylist())
            yield batch.filter(pa.array([s < most for s in scores]))

    return docs.mapInArrow(tidy(keep), docs.schema)


def learned(
    docs: DataFrame,
    labels: DataFrame,
    learn: F.Column | None = None,
    fit_toxic: int = 2000,
    fit_clean: int = 4000,
    fit_segments: int = 72,
    segments: int = 12_000,
) -> Field:
    """A field fitted to the labelled rows that ``learn`` (a condition on ``doc_id``) admits."""
    admitted = F.lit(True) if learn is None else learn
    rows = learning_rows(docs, labels, fit_toxic, fit_clean, fit_segments, admitted)
    marks = marked_types(rows)
    return fit_pieces(marked_pieces(rows, marks, segments) if marks else [], marks)
