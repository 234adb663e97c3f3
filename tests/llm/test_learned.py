"""Toxicity, language and personal data: exact kernels, held-out accuracy and edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.llm import language, personal_data, queries, toxicity
from holdfast.llm.common import settle
from holdfast.llm.common import held_out


@pytest.fixture(scope="module")
def middle_dir():
    return "/root/testdata/sf0.01"


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_folds_follow_the_crc_of_the_id(spark):
    rows = spark.createDataFrame([(i,) for i in (-7, 0, 1, 12, 9999)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", held_out(F.col("doc_id"), 5, 0)).collect()}
    assert got == {i: remainder(i, 5) == 0 for i in (-7, 0, 1, 12, 9999)} | {None: True}


def brute_marginals(emit, first, start, moves):
    """Sum over all state sequences of each text."""
    out, at = [], [*np.flatnonzero(first), len(emit)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        total, ones = 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=b - a):
            weight = start[states[0]]
            for i, j in itertools.pairwise(states):
                weight *= moves[i, j]
            for k, s in enumerate(states):
                weight *= emit[a + k] if s else 1.0
            total += weight
            ones += weight * np.array(states)
        out += (ones / total).tolist()
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_marginals_equal_all_sequences(block):
    rng = np.random.default_rng(5)
    emit, start, moves = np.exp(rng.normal(0, 2, 23)), np.exp(rng.normal(size=2)), np.exp(rng.normal(size=(2, 2)))
    first = np.zeros(23, bool)
    first[[0, 5, 6, 14]] = True
    got = toxicity.chain(emit, first, start, moves, block)
    assert got == pytest.approx(brute_marginals(emit, first, start, moves), abs=1e-9)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (5, 3, 2))
    y = rng.integers(0, 2, (5, 3))
    real = np.arange(5)[:, None] < np.array([5, 3, 1])
    theta = rng.normal(size=4 + 1 + 2 + 4)
    theta[0] = 0

    def loss(t):
        total = 0.0
        for j in range(3):
            n = int(real[:, j].sum())
            emit = t[x[:n, j]].sum(axis=1) + t[4]
            start, moves = t[5:7], t[7:].reshape(2, 2)

            def score(s, emit=emit, start=start, moves=moves):
                return start[s[0]] + sum(moves[a, b] for a, b in itertools.pairwise(s)) + sum(e for e, k in zip(emit, s, strict=True) if k)

            every = [score(s) for s in itertools.product((0, 1), repeat=n)]
            total += np.log(np.exp(every).sum()) - score(y[:n, j].tolist())
        return total

    got = toxicity._gradient(theta, 4, x, y * real, real)
    for k in range(1, len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-5
        assert got[k] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-5, abs=1e-5)


def test_toxicity_query_on_the_held_out_fold(spark, middle_dir):
    got = queries.QUERIES["op2_toxicity_field"](spark, middle_dir).toPandas()
    docs = pd.read_parquet(f"{middle_dir}/documents.parquet")
    labels = pd.read_parquet(f"{middle_dir}/labels.parquet")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert all(got["held_out"] == [remainder(i, 5) == 0 for i in got["doc_id"]])
    assert got["score"].between(0, 1).all() and all(got["predicted"] == (got["score"] >= 0.5))
    unseen = got[got["held_out"]].merge(labels, on="doc_id")
    assert (unseen["predicted"] == unseen["toxic"]).mean() >= 0.95
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    hits = got[got["spans"] != ""]
    words = {text[r.doc_id][int(a) : int(b)].lower() for r in hits.itertuples() for a, b in [s.split(":") for s in r.spans.split(",")]}
    assert {"idiot", "moron", "trash"} <= words


def test_toxicity_edges(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(1)
    common = [f"plain{i}" for i in range(30)]
    texts = [[rng.choice(common) for _ in range(12)] for _ in range(200)]
    for text in texts[:100]:
        text[rng.randrange(12)] = "badword"
    field = toxicity.fit([" ".join(t) for t in texts], np.array([1] * 100 + [0] * 100))
    got = toxicity.scored(odd_docs, field).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score < 0.5 for r in got)
    assert toxicity._judged(field, ["Badword!", None, ""])[0][0] >= 0.5
    assert toxicity._judged(field, [None, "", " "]) == ([0.0] * 3, [""] * 3)
    kept = toxicity.accepted(odd_docs, field)
    assert kept.schema == odd_docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect()))
    assert toxicity.scored(no_docs, field).count() == 0 and toxicity.accepted(no_docs, field).count() == 0


def test_toxicity_learns_from_long_texts(spark):
    """All toxic rows are long, and most labels have no document."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        words = [f"plain{k}" for k in rng.integers(0, 300, 6000 if i % 2 else 60)]
        if i % 2:
            for at in range(0, len(words), 25):
                words[at] = "badword"
        rows.append((i, " ".join(words)))
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string"), "long-toxic")
    labels = [(i, i % 2) for i in range(80)] + [(i, i % 2) for i in range(1000, 9000)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.learned(docs, labels, fit_toxic=40, fit_clean=40)
    assert {r.doc_id for r in toxicity.scored(docs, field).collect() if r.predicted} == set(range(1, 80, 2))
    assert toxicity.accepted(docs, field).count() == 40


def test_segments_are_spread_over_the_whole_text():
    tokens = [str(i) for i in range(toxicity.SEGMENT * 100 + 5)]
    assert toxicity.spread(tokens, 101) == [tokens] and toxicity.spread([], 3) == [[]]
    runs = toxicity.spread(tokens, 10)
    assert runs[0][0] == "0" and runs[-1] == tokens[-5:]
    assert len(runs) == 10 and all(len(r) == toxicity.SEGMENT for r in runs[:-1])
    assert sum(map(len, toxicity.spread(tokens, 90))) == toxicity.SEGMENT * 89 + 5


def test_toxicity_without_labels(spark, odd_docs):
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, None), (None, 1, 1)], [(0, 1, 0)], [(0, 1, 1), (0, 1, 0)]):
        field = toxicity.learned(odd_docs, spark.createDataFrame(rows, schema))
        assert {r.score for r in toxicity.scored(odd_docs, field).collect()} == {0.0}


def test_language_query_on_the_held_out_fold(spark, middle_dir):
    got = queries.QUERIES["op7_byte_network"](spark, middle_dir).toPandas()
    docs = pd.read_parquet(f"{middle_dir}/documents.parquet")
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and both["score"].between(0, 1).all()
    assert all(both["held_out"] == [remainder(i, 4) == 2 for i in both["doc_id"]])
    unseen = both[both["held_out"]]
    assert (unseen["lang_pred"] == unseen["lang"]).mean() >= 0.97


def test_language_edges(spark, odd_docs, odd_rows, no_docs):
    model = language.fit(["the fox and the dog"] * 20 + ["größe und fuß über"] * 20, ["en"] * 20 + ["de"] * 20)
    got = language.predicted(odd_docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    for r in got:
        text = next(t for i, t, *_ in odd_rows if i == r.doc_id)
        if not text or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    assert language.predicted(no_docs, model).count() == 0
    assert language.learned(no_docs) == {"names": []}
    assert {r.lang_pred for r in language.predicted(odd_docs, {"names": []}).collect()} == {"und"}


def test_windows_hold_whole_texts():
    texts = ["a", "B" * 127, "c" * 128, "d" * 129, "é" * 300]
    windows, owner, weight = language.windows_of(texts)
    for k, text in enumerate(texts):
        raw = text.lower().encode()
        assert b"".join(w.tobytes() for w in windows[owner == k])[: len(raw)] == raw
        assert weight[owner == k].sum() == len(raw)


def test_filters_by_pairs_equal_plain_convolution():
    model = language.fit(["abc def"] * 8 + ["xyz uvw"] * 8, ["a"] * 8 + ["b"] * 8)
    windows = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    tops = []
    for table, width in zip(model["filters"], language.WIDTHS, strict=True):
        out = [[sum(table[j][w[i + j]] for j in range(width)) for i in range(language.WINDOW - width + 1)] for w in windows]
        tops.append(np.max(out, axis=1))
    logits = np.maximum(np.concatenate(tops, axis=1), 0) @ model["weights"] + model["bias"]
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert language.Network(model).probabilities(windows) == pytest.approx(want, abs=1e-5)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[ -]", "", m.group())]
        odd = digits[::-1][::2]
        even = [2 * d - 9 * (d > 4) for d in digits[::-1][1::2]]
        if 14 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["a@.-1é ", "0123456789 -", "12.. 25", "+1 ().-0239a", "a1@b.c+2 -3"])
def test_fixed_patterns_equal_plain_expressions(letters):
    rng = random.Random(letters)
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def told(spans):
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check_personal(rows, text_of):
    for r in rows:
        text = text_of[r.doc_id] or ""
        base = plain_spans(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(told(base).split(",")) - {""} <= set(spans)
        for s in spans:
            kind, a, b = s.split(":")
            if kind == "secret":
                assert all(not (x < int(b) and int(a) < y) for x, _, y in base)


def test_personal_data_query(spark, middle_dir):
    docs = pd.read_parquet(f"{middle_dir}/documents.parquet")
    text_of = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = queries.QUERIES["op6_personal_data"](spark, middle_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs["doc_id"])
    check_personal(rows, text_of)
    taken = {text_of[r.doc_id][int(a) : int(b)] for r in rows for k, a, b in [s.split(":") for s in r.spans.split(",") if s] if k == "secret"}
    keys = {k for t in docs["text"] for k in re.findall(r'token = "([0-9a-f]{40})"', t)}
    assert keys and keys <= taken
    assert not any(t in taken for t in ("2.0", "3", "4.0", "2", "4"))


def test_personal_data_edges(spark, odd_docs, odd_rows, no_docs):
    found, weights = personal_data.found_in(odd_docs)
    rows = personal_data.digests(found, weights).collect()
    assert len(rows) == len(odd_rows)
    check_personal([r for r in rows if r.doc_id not in (8, 12)], {r[0]: r[1] for r in odd_rows})
    masked = personal_data.masked(odd_docs, weights)
    assert masked.schema == odd_docs.schema
    by_id = {r.doc_id: r for r in masked.collect()}
    assert by_id[3].text is None and by_id[3].n_chars is None
    assert "bob@" not in by_id[-5].text and "[EMAIL]" in by_id[-5].text and "[PHONE]" in by_id[-5].text
    assert by_id[-5].n_chars == len(by_id[-5].text) and by_id[0].text == odd_rows[0][1]
    found, weights = personal_data.found_in(no_docs)
    assert personal_data.digests(found, weights).count() == 0 and personal_data.masked(no_docs, weights).count() == 0


def test_em_tells_good_labelers_from_bad():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = (0.95, 0.9, 0.85, 0.5, 0.8, 0.75)
    votes = ["".join("+" if (t if rng.random() < p else not t) else "-" for p in right) for t in truth]
    patterns, counts = np.unique(votes, return_counts=True)
    p, table = personal_data.reliabilities(patterns.tolist(), counts.astype(float))
    known = dict(zip(patterns, p, strict=True))
    assert np.mean([(known[v] >= 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.95
    accuracy = [(table[k, 1, 2] + table[k, 0, 0]) / 2 for k in range(6)]
    assert accuracy == pytest.approx(right, abs=0.04)
