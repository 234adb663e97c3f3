"""Quality rules, bit-sliced search, the prefix-tree join and the pipeline against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from holdfast.llm import bitsliced, components, prefix_tree, quality, queries
from holdfast.llm.common import settle

GAP = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(result.fetchall())


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(f"[{GAP}]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(f"[^{GAP}]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_quality_edges(spark, odd_docs, odd_rows, no_docs):
    got = quality.verdicts(odd_docs).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[f] for f in fields)) for r in got) == sorted(
        (str(i), *brute_counts(t)) for i, t, *_ in odd_rows
    )
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality.verdicts(no_docs).count() == 0
    kept = quality.filtered(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {r.doc_id for r in got if r.kept and r.doc_id is not None}
    assert {r.doc_id for r in kept.collect()} == want


def test_quality_counts_on_noise(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n#\té|") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.rated(quality.measured(rows)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(text)


def test_sketches_merge_and_bound_the_error(spark):
    values = np.random.default_rng(1).integers(0, 100_000, 5000).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.expr(quality.bucket("v")).alias("b"))
    for r in rows.collect():
        assert r.b <= r.v and r.v - r.b <= r.v / 64


def test_native_plan_has_no_python(spark, odd_docs):
    plan = quality.verdicts(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, row string, low string")


def brute_nearest(rows, k=5, every=50, scale=256):
    kept = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if vec_id not in kept or v > kept[vec_id]:
            kept[vec_id] = v
    width = max((len(v) for v in kept.values()), default=0)
    units = {i: [int(np.floor(x * scale)) for x in v] + [0] * (width - len(v)) for i, v in kept.items()}
    out = set()
    for q in units:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(units[q], units[i], strict=True)), i) for i in units if i != q)
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("block_rows, block_queries", [(1 << 15, 128), (40, 3)])
def test_search_equals_brute_force(spark, block_rows, block_queries):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(300)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 420)]  # ties
    rows += [(50, [9.0] * 6), (420, None), (421, [1.0, None]), (422, [float("nan")]), (423, [float("inf")]), (424, [])]
    rows += [(None, [1.0] * 6), (-100, [-3.5, 1e4, 0.001]), (3, rows[3][1])]
    rows = [(*r, "own", "own", "own") for r in rows]
    got = bitsliced.nearest(vectors(spark, rows), block_rows=block_rows, block_queries=block_queries)
    assert set(map(tuple, got.collect())) == brute_nearest(rows)


def test_search_edges(spark):
    assert bitsliced.nearest(vectors(spark, [])).count() == 0
    assert bitsliced.nearest(vectors(spark, [(0, [1.0], "", "", "")])).count() == 0
    two = [(0, [1.0], "", "", ""), (7, [-1.0], "", "", "")]
    assert [tuple(r) for r in bitsliced.nearest(vectors(spark, two)).collect()] == [(0, 1, 7, -65536)]
    with pytest.raises(Exception, match="62 bits"):
        bitsliced.nearest(vectors(spark, [(0, [3e38], "", "", ""), (1, [3e38], "", "", "")])).collect()


def brute_set(text):
    words = [w for w in re.split(f"[{GAP}]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute_groups(rows, percent=75):
    """(id, set size, component) of every row with an id, by comparing all pairs."""
    rows = [(i, brute_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            shared = len(x & y)
            if i != j and shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(x), find(i)) for i, x in rows)


def near_copies(n, seed):
    """A large group of copies and near copies, chains, and texts that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(120)]
    out, chain = [], [rng.choice(words) for _ in range(80)]
    for k in range(n):
        kind = k % 6
        if kind == 0:
            text = list(base)
        elif kind in (1, 2):
            text = list(base)
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 3:
            chain = list(chain)
            chain[rng.randrange(len(chain))] = f"c{k}"
            text = chain
        elif kind == 4:
            text = passage + [rng.choice(words) for _ in range(rng.randint(1, 60))]
        else:
            text = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        out.append((1000 - k, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_groups_equal_brute_force(spark, block):
    rows = near_copies(260, block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = prefix_tree.groups(df, block=block).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


@pytest.mark.parametrize("times", [2, 3])
def test_repeated_rows_of_a_cluster_with_few_ids(spark, times):
    rng = random.Random(times)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(6):  # six ids: more rows than a block, not more ids
        own = list(words)
        own[rng.randrange(70, 80)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = settle(spark.createDataFrame(rows * times, "doc_id long, text string"), "repeated")
    want = brute_groups(rows)
    assert {c for _, _, c in want} == {0}
    got = prefix_tree.groups(df, block=6).collect()
    assert sorted(map(tuple, got)) == sorted(want * times)
    assert prefix_tree.representatives(df, block=6).count() == 1


def test_groups_edges(spark, odd_docs, odd_rows, no_docs):
    got = prefix_tree.groups(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    want = brute_groups([r[:2] for r in odd_rows])
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert prefix_tree.groups(no_docs).count() == 0
    kept = prefix_tree.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter({i for i, _, c in want if i == c} | {None})
    assert prefix_tree.representatives(no_docs).count() == 0


def test_trees_find_all_components():
    rng = random.Random(6)
    for _ in range(150):
        percent = rng.choice([50, 75, 90])
        cores = [rng.sample(range(300), rng.randint(1, 30)) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 40)):
            own = set(rng.choice(cores))
            for _ in range(rng.randint(0, 5)):
                own.symmetric_difference_update({rng.randint(0, 320)})
            sets.append(own or {999})
        cells = [np.array(sorted(s), "<u8") for s in sets]
        links = prefix_tree.joined(
            prefix_tree._numbered_sets(cells), np.array([len(s) for s in sets]), np.arange(len(sets)), percent
        )
        got, want = list(range(len(sets))), list(range(len(sets)))

        def find(root, i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
            got[find(got, a)] = find(got, b)
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    want[find(want, a)] = find(want, b)
        for a in range(len(sets)):
            for b in range(a):
                assert (find(got, a) == find(got, b)) == (find(want, a) == find(want, b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (260, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 261)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, before, sf_dir), name)
        a, b = before.toPandas(), after.toPandas()
        if name == "packing":
            assert sorted(set(b["doc_id"])) == sorted(a["doc_id"])
            assert set(b.groupby("sequence_id")["length"].sum()) <= set(range(2049))
            break
        assert after.columns == before.columns
        if name == "toxicity":
            labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
            clean = set(labels[labels["toxic"] == 0]["doc_id"])
            assert len(clean - set(b["doc_id"])) <= 0.03 * len(clean) and len(b) < len(a)
        if name == "near_duplicates":
            want = brute_groups(list(zip(a["doc_id"], a["text"], strict=True)))
            assert sorted(b["doc_id"]) == [i for i, _, c in want if i == c]
        if name in ("personal_data", "mixing"):
            assert sorted(b["doc_id"]) == sorted(a["doc_id"])
        if name == "personal_data":
            assert not b["text"].str.contains(r"@[a-z0-9]+\.example\.com").any()
            assert (b["n_chars"] == b["text"].str.len()).all()
        before = after


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = settle(stage(spark, docs, sf_dir), name)
            assert name == "packing" or after.columns == docs.columns
            assert (after.count() > 0) == (docs is not no_docs and docs.count() > 0)
            docs = after
