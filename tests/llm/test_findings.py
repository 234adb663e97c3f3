"""Words that hash alike, long runs of digits, rare languages, bounded draws, and packing of many equal pieces."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdfast.llm import language, packing, personal_data, prefix_tree, queries, toxicity
from holdfast.llm.common import drawn, settle, tokenizer_path
from holdfast.llm.tokens import WordEncoder


def thue_morse(n):
    """Two words of n letters, each the other with letters swapped: their sums of code times power of an odd number agree modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_hash_alike_keep_their_ids(name, n):
    library = Tokenizer.from_file(tokenizer_path(name))
    one, two = thue_morse(n)
    texts = [f"say {one} now", f"say {two} now", one, two, f"{one} {two}", "plain words", f"{two} {one}"]
    encoder = WordEncoder(tokenizer_path(name), added=True)
    for batch in (texts, texts[:1], texts[1:2], texts[::-1]):
        ids, counts = encoder.encode_all(batch)
        for text, own in zip(batch, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_that_hash_alike_make_no_link(spark):
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        one, two = thue_morse(n)
        for i, word in enumerate((one, two)):
            rows.append((10 * k + i, " ".join([word, "and", "four", "more", "words"])))
        rows.append((10 * k + 2, " ".join([one.upper(), "and", "four", "more", "words"])))
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string"), "alike")
    got = {r.doc_id: r.component_id for r in prefix_tree.groups(docs).collect()}
    assert got == {10 * k + i: 10 * k + (1 if i == 1 else 0) for k in range(3) for i in range(3)}


def test_address_with_very_long_parts(spark, tmp_path):
    zeros = "0" * 5000
    texts = [f"at {zeros}10.0.{zeros}.1 here", f"1.2.3.{zeros}256", f"{zeros}.{zeros}.{zeros}.{zeros}", "9" * 6000 + ".1.1.1"]
    assert [[s[1] for s in personal_data.base_spans(t) if s[1] == 1] for t in texts] == [[1], [], [1], []]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = {r.doc_id: r.n_ip for r in queries.QUERIES["op6_personal_data"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0}


def test_representatives_with_columns_that_have_no_order(spark):
    rows = [(1, "one two three four five six", {"k": 2}), (1, "one two three four five six", {"k": 1}), (2, None, None)]
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>"), "maps")
    got = sorted((r.doc_id, r.extra) for r in prefix_tree.representatives(docs).collect())
    assert got == [(1, {"k": 1}), (2, None)]


def labelled_texts(seed, n=260):
    rng = random.Random(seed)
    common = [f"plain{i}" for i in range(40)] + ["a", "be", "Über", "straße"]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["badword", "badness", "baddies", "Awful"]))
        elif i % 40 == 1:
            words.append("awful")
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_marked_types_equal_the_count_in_memory(spark, seed):
    rows = labelled_texts(seed)
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string"), "types")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    kept = toxicity.learning_rows(docs, labels, 2000, 4000, 72, F.lit(True))
    runs = [[toxicity.TOKEN.findall(t.lower())] for _, t in rows]
    want = toxicity.toxic_types(runs, np.array([int(i % 3 == 0) for i, _ in rows]))
    assert want and toxicity.marked_types(kept) == want
    pieces = toxicity.marked_pieces(kept, want, 10_000)
    assert sum(len(p) for _, p in pieces) == sum(len(r[0]) for r in runs)
    marked = [any(t in want for w in own[0] for t in toxicity._types(w)) for own in runs]
    assert sum(hit for hit, _ in pieces) == sum(m for m, (i, _) in zip(marked, rows, strict=True) if i % 3 == 0) > 70
    few = toxicity.marked_pieces(kept, want, 7)
    assert [hit for hit, _ in few].count(True) == 7 and len(few) == 14


def test_learning_rows_are_bounded_and_equal_rows_count_once(spark):
    rows = [(i % 20, f"text number {i % 60}") for i in range(600)]
    docs = settle(spark.createDataFrame(rows, "doc_id long, text string"), "bounded")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    every = toxicity.learning_rows(docs, labels, 1000, 1000, 72, F.lit(True)).collect()
    assert len(every) == 60
    few = toxicity.learning_rows(docs, labels, 5, 3, 72, F.lit(True)).collect()
    assert [r.toxic for r in few].count(1) == 5 and [r.toxic for r in few].count(0) == 3


def test_drawn_rows_are_those_of_least_lot(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("lot"), "id")
    want = sorted(r.lot for r in df.collect())[:37]
    assert sorted(r.lot for r in drawn(df, "lot", 37).collect()) == want
    assert drawn(df, "lot", 5000).count() == 1000 and drawn(df.where("false"), "lot", 5).count() == 0


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with"], "xx": ["zqzq", "qxqx", "wzwz"]}
    rows = [(i, " ".join(rng.choice(words["en"]) for _ in range(9)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(rng.choice(words["xx"]) for _ in range(9)), "xx") for i in range(4)]
    docs = settle(spark.createDataFrame(rows + rows[:1] * 50, "doc_id long, text string, lang string"), "langs")
    texts, langs = language.learning_windows(docs, F.lit(True), 20, 2)
    assert 20 <= langs.count("en") <= 40 and 4 <= langs.count("xx") <= 8
    model = language.learned(docs, lang_rows=50, row_windows=2)
    got = language.predicted(docs.where("doc_id >= 5000"), model).collect()
    assert {r.lang_pred for r in got} == {"xx"}


def test_many_equal_pieces_are_packed_at_once():
    began = time.monotonic()
    fixed, left = packing.reduced({1500: 1_000_000, 500: 1_000_000, 900: 77}, 2048)
    assert time.monotonic() - began < 1
    n = {}
    for pattern, times in [*fixed, *packing.best_fit(left, 2048)]:
        assert sum(size * k for size, k in pattern) <= 2048
        for size, k in pattern:
            n[size] = n.get(size, 0) + k * times
    assert n == {1500: 1_000_000, 500: 1_000_000, 900: 77}


def test_only_shared_ngrams_bring_texts_together(spark, monkeypatch):
    """Copies of unlike texts send no n-gram, and pairs that share a common passage do not meet through it."""
    seen = {}

    def settle(df, purpose, write=prefix_tree.settle):
        seen[purpose] = write(df, purpose)
        return seen[purpose]

    monkeypatch.setattr(prefix_tree, "settle", settle)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = []
    for k in range(40):
        own = " ".join(f"w{k}x{i}" for i in range(60))
        rows += [(4 * k, f"{own} {passage}"), (4 * k + 1, f"{own} {passage} more")]
        copied = " ".join(f"c{k}x{i}" for i in range(50))
        rows += [(4 * k + 2, copied), (4 * k + 3, copied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in prefix_tree.groups(docs).collect()}
    assert found == {i: i - i % 2 for i in range(160)}
    sent = {r.doc_id for r in seen["prefixes"].collect()}
    assert sent == {i for i in range(160) if i % 4 < 2}
    assert {r.members for r in seen["clusters"].collect()} == {2}


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = disk.getAllFiles().mkString("\n").split("\n")  # one look, since the cleaner runs beside
        return {f for f in found if "shuffle_" in f}

    spark.range(10).repartition(3).count()
    before = files()
    counted = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert not files() - before
    assert counted.agg(F.sum("count")).first()[0] == 1000
