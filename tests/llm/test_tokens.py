"""Token files, packing and token counts against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from holdfast.llm import packing, queries, token_files, viterbi
from holdfast.llm.common import tokenizer_path
from holdfast.llm.tokens import WordEncoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
LETTERS = "aAb  \n\t\x0b\x1c\x85\xa0 　'sréİĳ́Σ.,-ςÉ12<|endoftext|>!?#ü日本\x00᠎’▁"


def library(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name, small_docs):
    rng = random.Random(4)
    texts = [None, "", *small_docs["text"]]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = library(name)
    encoder = WordEncoder(tokenizer_path(name), most_words=500)  # begins anew many times
    for k in range(0, len(texts), 111):
        ids, counts = encoder.encode_all(texts[k : k + 111])
        for text, own in zip(texts[k : k + 111], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == want(text), text


def unmodified(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_unmodified_library(name):
    rng = random.Random(9)
    units = [*LETTERS, *["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"] * 9, "<|", "Σ<|endoftext|>", "  <|endoftext|>\n"]
    texts = [None, "", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|startoftext|> b"]
    texts += ["".join(rng.choice(units) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = unmodified(name)
    encoder = WordEncoder(tokenizer_path(name), most_words=500, added=True)
    for k in range(0, len(texts), 111):
        ids, counts = encoder.encode_all(texts[k : k + 111])
        for text, own in zip(texts[k : k + 111], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == want(text), text


def test_queries_take_added_tokens_as_one_id(spark, tmp_path):
    texts = ["one <|endoftext|> two", "<|startoftext|>three<|endoftext|>", None, "four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for op, name, end in (("op1_token_files", FILES[0], 2), ("op9_best_fit_packing", FILES[1], 0)):
        encode = unmodified(name)
        got = {r.doc_id: r.ids_crc32 for r in queries.QUERIES[op](spark, str(tmp_path)).collect()}
        assert got == {i: crc([*encode(t), end]) for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_packed_values_come_back(values):
    control, data = token_files.pack(np.array(values, "<u4"))
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack(control, data, len(values)).tolist() == values


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark, sf_dir, small_docs):
    want, start = [], 0
    encode = library(FILES[0])
    for row in small_docs.sort_values("doc_id").itertuples():
        ids = [*encode(row.text), 2]
        want.append((row.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.QUERIES["op1_token_files"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == want


def test_token_files_edges(spark, odd_docs, odd_rows, no_docs):
    encode = library(FILES[0])
    files = token_files.write(odd_docs, tokenizer_path(FILES[0]), end_id=2)
    got = token_files.digests(spark, files).collect()
    want = sorted(((r[0] is not None, r[0]), len(encode(r[1])) + 1, crc([*encode(r[1]), 2])) for r in odd_rows)
    assert sorted(((r.doc_id is not None, r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts[:-1]]]).tolist()
    assert starts[0][1] == next(n for (known, _), n, _ in want if not known)  # null ids come first
    files = token_files.write(no_docs, tokenizer_path(FILES[0]), end_id=2)
    assert token_files.digests(spark, files).count() == 0


def test_frequent_ids_get_small_ranks(spark, odd_docs):
    files = token_files.write(odd_docs, tokenizer_path(FILES[0]), end_id=2)
    ids = token_files.read(spark, files).toPandas()["ids"]
    values, counts = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in ids]), return_counts=True)
    ranks = {r.id: r["rank"] for r in spark.read.parquet(files.ranks).collect()}
    assert sorted(ranks) == values.tolist()
    by_rank = sorted(zip(values.tolist(), counts.tolist(), strict=True), key=lambda x: ranks[x[0]])
    assert all(a[1] >= b[1] for a, b in zip(by_rank, by_rank[1:], strict=False))


def least_bins(sizes, capacity):
    """Fewest sequences by trying everything; small instances only."""
    best = len(sizes)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                place(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_fixed_sets_cost_no_sequence(sizes):
    """Dominance is exact: what is fixed, plus the best for the rest, is the best for all."""
    values, counts = np.unique(sizes, return_counts=True)
    fixed, rest = packing.reduced(dict(zip(values.tolist(), counts.tolist(), strict=True)), 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + least_bins(left, 20) == least_bins(sizes, 20)


@pytest.mark.parametrize("capacity, n", [(50, 300), (2048, 100_000)])
def test_plan_holds_every_piece_once(capacity, n):
    sizes = np.minimum(capacity, 1 + np.random.default_rng(n).exponential(capacity / 4, n).astype(int))
    values, counts = np.unique(sizes, return_counts=True)
    want = dict(zip(values.tolist(), counts.tolist(), strict=True))
    plan = packing.plan(want, capacity)
    got = dict.fromkeys(want, 0)
    for pattern, times in plan:
        assert sum(size * each for size, each in pattern) <= capacity
        for size, each in pattern:
            got[size] += each * times
    assert got == want
    assert sum(t for _, t in plan) <= -(-sizes.sum() // capacity) * 1.02 + 1


def check_packing(got, texts, capacity):
    encode = library(FILES[1])
    want = []
    for doc_id, text in texts:
        ids = [*encode(text), 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((str(doc_id), k // capacity, k, len(part), crc(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist()
        assert sum(n for _, n in places) <= capacity
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // capacity) * 1.05 + 1


def test_packing_query(spark, sf_dir, small_docs):
    got = queries.QUERIES["op9_best_fit_packing"](spark, sf_dir).collect()
    check_packing(got, zip(small_docs["doc_id"], small_docs["text"], strict=True), 2048)


def test_packing_edges(spark, odd_docs, odd_rows, no_docs):
    path = tokenizer_path(FILES[1])
    placed = packing.packed(odd_docs, path, capacity=64)
    got = placed.collect()
    check_packing(got, [(r[0], r[1]) for r in odd_rows], 64)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(placed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tolist() == np.frombuffer(r.ids, "<u4").tolist()
    assert packing.packed(no_docs, path).count() == 0


def unigram(vocabulary, byte_pieces):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_pieces))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.BLANK, prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_counts_equal_the_library(byte_pieces, small_docs):
    vocabulary = viterbi.zipf_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    if not byte_pieces:
        vocabulary = [x for x in vocabulary if not x[0].startswith("<0x")]
    counter, want = viterbi.Counter(vocabulary, byte_pieces), unigram(vocabulary, byte_pieces)
    rng = random.Random(9)
    texts = [None, "", " ", *small_docs["text"]]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text in texts:
        assert counter.text(text)[0] == want(text), text


def test_ties_go_to_the_longer_last_piece():
    """Equal scores: of the ways to one place, the one whose last piece begins first."""
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("▁aa", -3.0)]
    counter, want = viterbi.Counter(vocabulary, False), unigram(vocabulary, False)
    for text in ("a", "aa", "aaa", "aaaa", "a aa", "xx a", "xxa"):
        assert counter.text(text)[0] == want(text)


def test_token_count_query(spark, sf_dir, small_docs, odd_docs, odd_rows, no_docs):
    path = tokenizer_path("piece_bpe_32k.model")
    want = unigram(viterbi.zipf_vocabulary(path), True)
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op5_token_counts"](spark, sf_dir).collect()}
    assert got == {r.doc_id: want(r.text) for r in small_docs.itertuples()}
    odd = viterbi.token_counts(odd_docs, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in odd) == sorted((str(r[0]), want(r[1])) for r in odd_rows)
    assert viterbi.token_counts(no_docs, path).count() == 0
