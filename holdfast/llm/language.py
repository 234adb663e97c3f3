"""Language by a convolutional network over bytes.

Lower-cased UTF-8 text is cut into windows of fixed length. Filters of several widths run over a window's bytes,
each filter's greatest response in the window goes through a rectifier into a softmax over the languages.
The network is trained in numpy by Adam; a filter is a table of weights per place and byte, so its
gradient touches only the bytes where it responded most. A trained filter is applied by looking up byte pairs:
a width of four is two lookups per byte. A text's prediction is the mean of its windows' probabilities,
weighted by their bytes.

The fit takes at most ``lang_rows`` labelled rows of each language, chosen by a hash of their id and text, so that a
rare language is learned too, and ``row_windows`` windows at hashed places of each; everything else covers all
rows and whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if no
labelled row has letters; a null language is not learned from; equal rows are judged alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import small_batches

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 128
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def learning_windows(
    docs: DataFrame, learn: F.Column, lang_rows: int, row_windows: int, id_col="doc_id", text_col="text", lang_col="lang"
) -> tuple[list[str], list[str]]:
    """(windows of text, their languages): at most ``lang_rows`` rows of each reach the driver, by short cuts only.

    The lots of a language are compared without the texts; only rows below its cut are read again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("lot", F.xxhash64("doc_id", "text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("lot"))
    cut = rows.select("lang", "lot").withColumn("nth", first).where(F.col("nth") <= lang_rows)
    cut = cut.groupBy("lang").agg(F.max("lot").alias("cut"))
    size = F.length("text")
    cuts = [
        F.substring(
            "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit(k)), F.greatest(size - WINDOW, F.lit(0)) + 1) + 1).cast("int"),
            F.lit(WINDOW),
        )
        for k in range(row_windows)
    ]
    # one row per language, as in the model itself
    few = rows.join(F.broadcast(cut), "lang").where("lot <= cut").select("lang", "lot", F.array(*cuts).alias("cuts"))
    # equal rows have one lot; of such rows one is learned from
    found = few.dropDuplicates(["lang", "lot"]).orderBy("lang", "lot").toPandas()
    texts = [c for cuts in found["cuts"] for c in dict.fromkeys(cuts)]
    langs = [g for cuts, g in zip(found["cuts"], found["lang"], strict=True) for _ in dict.fromkeys(cuts)]
    return texts, langs


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes, the text each belongs to, bytes of the text in each); blanks fill up the last one."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    counts = -(-sizes // WINDOW)
    data = np.frombuffer(b"".join([r.ljust(int(n) * WINDOW) for r, n in zip(raw, counts, strict=True)]), np.uint8)
    owner = np.repeat(np.arange(len(raw)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data.reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - nth * WINDOW, WINDOW)


def fit(texts: list[str], langs: list[str], epochs: int = 8, steps: int = 200, batch: int = 256, rate=0.01) -> dict:
    """Filter tables and softmax layer, trained on labelled windows for ``epochs`` or ``steps``, whichever is longer."""
    names = sorted(set(langs))
    if not names:
        return {"names": []}
    data = np.stack([np.frombuffer(t.lower().encode()[:WINDOW].ljust(WINDOW), np.uint8) for t in texts])
    truth = np.searchsorted(names, langs)
    rng = np.random.default_rng(7)
    shapes = [(w, 256, FILTERS) for w in WIDTHS]
    theta = [rng.normal(0, 0.3, s).astype(np.float32) for s in shapes]
    theta += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(max(epochs, -(-steps * batch // len(data)))):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            x, y = data[rows], truth[rows]
            here = np.arange(len(rows))[:, None]
            tops, places = [], []
            for table, width in zip(theta, WIDTHS, strict=False):
                out = sum(table[j][x[:, j : WINDOW - width + 1 + j]] for j in range(width))
                at = out.argmax(axis=1)
                places.append(at)
                tops.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
            hidden = np.maximum(np.concatenate(tops, axis=1), 0)
            logits = hidden @ theta[-2] + theta[-1]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            back = (p @ theta[-2].T) * (hidden > 0)
            grads = []
            for n, (table, width) in enumerate(zip(theta, WIDTHS, strict=False)):
                g = np.zeros_like(table)
                mine = back[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(width):
                    np.add.at(g[j], (x[here, places[n] + j], np.arange(FILTERS)[None]), mine)
                grads.append(g)
            grads += [hidden.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                theta[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return {"names": names, "filters": theta[:-2], "weights": theta[-2], "bias": theta[-1]}


class Network:
    """A trained network with its filters as tables over byte pairs."""

    def __init__(self, model: dict):
        self.names = model["names"]
        if not self.names:
            return
        self._weights, self._bias = model["weights"], model["bias"]
        self._tables = []  # per width: (table over a byte pair or byte, its place)
        for table in model["filters"]:
            width = len(table)
            parts = []
            for j in range(0, width - 1, 2):
                pair = (table[j][:, None] + table[j + 1][None]).reshape(65536, FILTERS)
                parts.append((np.ascontiguousarray(pair), j, True))
            if width % 2:
                parts.append((np.ascontiguousarray(table[-1]), width - 1, False))
            self._tables.append((width, parts))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of each window."""
        out = []
        for k in range(0, len(windows), 512):
            x = windows[k : k + 512]
            pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
            tops = []
            for width, parts in self._tables:
                span = WINDOW - width + 1
                response = None
                for table, j, paired in parts:
                    found = table.take((pairs if paired else x)[:, j : j + span], axis=0)
                    response = found if response is None else np.add(response, found, out=response)
                tops.append(response.max(axis=1))
            logits = np.maximum(np.concatenate(tops, axis=1), 0) @ self._weights + self._bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.names)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(languages, scores) of whole texts."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.names:
            return langs, scores
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        windows, owner, weight = windows_of([texts[i] for i in known])
        p = self.probabilities(windows).astype(np.float64) * weight[:, None]
        first = np.searchsorted(owner, np.arange(len(known)))
        if len(known):
            total = np.add.reduceat(p, first, axis=0) / np.add.reduceat(weight, first)[:, None]
            best = total.argmax(axis=1)
            for row, i in enumerate(known):
                langs[i] = self.names[best[row]]
                scores[i] = float(min(max(total[row, best[row]], 0.0), 1.0))
        return langs, scores


def learned(docs: DataFrame, learn: F.Column | None = None, lang_rows: int = 1000, row_windows: int = 4, **columns: str) -> dict:
    """A model from the labelled rows that ``learn`` (a condition on ``doc_id``) admits."""
    return fit(*learning_windows(docs, F.lit(True) if learn is None else learn, lang_rows, row_windows, **columns))


def predicted(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; a projection without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value)
        for batch in small_batches(batches, most_bytes=2 << 20):
            langs, scores = network.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")
