"""Pfair mixing: deadlines, deviation and whole results."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import mixing, packing, queries
from holdfast.llm.common import settle, tokenizer_path, written_place


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1))
def test_less_than_one_block_from_the_target(weights):
    parts = sum(weights.values())
    order = sorted((int(t), s) for s, slots in mixing.period(weights).items() for t in slots)
    assert [t for t, _ in order] == list(range(parts))
    taken = Counter()
    for t, (_, s) in enumerate(order, 1):
        taken[s] += 1
        assert all(abs(taken[x] * parts - weights[x] * t) < parts for x in weights)


@settings(max_examples=60, deadline=None)
@given(
    st.dictionaries(st.sampled_from("abcde"), st.integers(1, 40), min_size=1),
    st.dictionaries(st.sampled_from("abcde"), st.floats(0.0, 5.0)),
)
def test_phases_place_every_block_once(blocks, weights):
    plan = mixing.phases(blocks, weights, 20)
    slots = [int(t) for s, n in blocks.items() for t in mixing.slot_of(plan, s, np.arange(n), 20)]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_shares_sum_and_none_is_lost():
    own = mixing.shares({"a": 1000.0, "b": 1.0, "c": 0.001}, 100)
    assert sum(own.values()) == 100 and min(own.values()) >= 1 and own["a"] > 90


def brute_slots(blocks, weights, parts):
    """The schedule by simulation, slot for slot, with new phases as sources end."""
    left, out, t, begin = dict(blocks), {}, 0, 0
    done = Counter()
    own, phase = None, None
    while left:
        if phase != set(left):
            phase = set(left)
            weighted = {s: weights[s] for s in left if weights.get(s, 0) > 0}
            own = mixing.shares(weighted or dict.fromkeys(left, 1.0), parts)
            begin, ran = t, Counter()
        now = t - begin
        ready = [(-(-(ran[s] + 1) * parts // w), s) for s, w in own.items() if ran[s] * parts // w <= now]
        _, s = min(ready)
        out[s, done[s]] = t
        done[s] += 1
        ran[s] += 1
        left[s] -= 1
        if not left[s]:
            del left[s]
        t += 1
    return out


def test_slots_equal_a_simulation():
    blocks, weights = {"=a": 50, "=b": 7, "=c": 20, "-": 3}, {"=a": 3.0, "=b": 2.0, "=c": 1.0, "-": 0.5}
    plan = mixing.phases(blocks, weights, 30)
    want = brute_slots(blocks, weights, 30)
    got = {(s, i): int(t) for s, n in blocks.items() for i, t in enumerate(mixing.slot_of(plan, s, np.arange(n), 30))}
    assert got == want


def test_mixing_query(spark, sf_dir, small_docs):
    rows = queries.QUERIES["op4_pfair_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(small_docs["doc_id"])
    size = Counter(small_docs["source"])
    blocks = {f"={s}": -(-n // 64) for s, n in size.items()}
    want = brute_slots(blocks, {f"={s}": n**0.5 for s, n in size.items()}, mixing.PARTS)
    for r in rows:
        assert want[f"={r.source}", r.block] == r.slot
    filled = Counter((r.source, r.block) for r in rows)
    assert all(n == min(64, size[s] - 64 * b) for (s, b), n in filled.items())


def test_mixing_edges(odd_docs, odd_rows, no_docs):
    mix = mixing.interleaved(odd_docs, block_docs=2)
    assert mix.columns == odd_docs.columns
    assert sorted(map(str, mix.collect())) == sorted(map(str, odd_docs.collect()))
    weights = {"a": 3.0, None: 1.0, "nowhere": 2.0}
    slots = mixing.mixed(odd_docs, weights, block_docs=1).select("row.source", "slot").collect()
    assert sorted(r.slot for r in slots) == list(range(len(odd_rows)))
    last = max(r.slot for r in slots if r.source in ("a", None))
    assert all(r.slot > last for r in slots if r.source in ("b", "c"))  # sources without a weight follow
    assert mixing.interleaved(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(odd_docs, parts=2)


def test_weights_of_the_mix_reach_the_sequences(spark, sf_dir, small_docs, monkeypatch):
    sources = sorted(small_docs["source"].unique())
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    plain, first = mixing.interleaved, {}
    for heavy in (sources[0], sources[-1]):
        weights = {s: 1000.0 if s == heavy else 1.0 for s in sources}
        monkeypatch.setattr(mixing, "interleaved", lambda d, w=weights: plain(d, weights=w, block_docs=2))
        rows = corpus_pipeline.run(spark, sf_dir).toPandas().merge(small_docs[["doc_id", "source"]])
        assert set(rows["doc_id"]) == set(small_docs["doc_id"])
        assert (rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"].sum() <= 2048).all()
        place = rows.groupby("source")["sequence_id"].mean()
        assert place.idxmin() == heavy
        first[heavy] = rows.set_index(["doc_id", "piece"])["sequence_id"].to_dict()
    assert first[sources[0]] != first[sources[-1]]


def test_written_order_comes_back(spark, odd_docs):
    rows = settle(spark.range(3000).repartition(7).repartitionByRange(5, F.desc("id")).sortWithinPartitions(F.desc("id")), "order")
    got = [r.id for r in written_place(rows, "at").orderBy("at").collect()]
    assert got == list(range(2999, -1, -1))
    made = spark.createDataFrame([(i,) for i in range(20)], "id long")
    assert [r.id for r in written_place(made, "at").orderBy("at").collect()] == list(range(20))


def test_windows_follow_each_other(spark, small_docs, sf_dir):
    docs = written_place(spark.read.parquet(f"{sf_dir}/documents.parquet"), "at")
    rows = packing.packed_in_order(docs, tokenizer_path("word_bpe_49k.json"), "at", window=100).toPandas()
    at = {r.doc_id: r["at"] for r in docs.select("doc_id", "at").collect()}
    rows["at"] = rows["doc_id"].map(at)
    spans = rows.groupby("sequence_id")["at"].agg(["min", "max"]).sort_index()
    assert list(spans.index) == list(range(len(spans)))
    assert np.corrcoef(spans.index, spans["min"])[0, 1] > 0.95
    assert sorted(rows["doc_id"].unique()) == sorted(small_docs["doc_id"])
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy()[1:] == own["length"].cumsum().to_numpy()[:-1]).all()
        assert own["length"].sum() <= 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=200))
def test_pieces_in_order_fill_each_place_once(lengths):
    length = np.array(lengths)
    sequence, offset = packing.in_order(length, 30)
    assert sorted(set(sequence)) == list(range(max(sequence) + 1))
    taken = [(s, o + k) for s, o, n in zip(sequence, offset, lengths, strict=True) for k in range(n)]
    assert len(set(taken)) == len(taken) and max(o for _, o in taken) < 30
