"""The source audit against brute force and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from holdfast.llm import divergence, oracles, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs, most):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def share(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def collected(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]


@pytest.mark.parametrize(("block", "terms", "entries"), [(128, 500, 300_000), (2, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, block, terms, entries):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "É", "é", "日本", "Δx", "zeta", "a", "B", "rho", "ſ", "K"]
    rows = []
    for _ in range(300):
        k = rng.randint(0, 12)
        text = rng.choice(" 1,\n-").join(rng.choice(words[: 4 + rng.randint(0, 9)]) for _ in range(k))
        rows.append((rng.choice([text, text, "Alpha beta alpha"]), rng.choice("ab"), f"s{rng.randint(0, 6)}"))
    rows += [("only here twice twice", "c", "s1"), (None, "c", "s2"), ("", "d", "s1"), ("x", "d", "s2"), ("alone", "e", None)]
    rows += [("same text in many", None, f"s{k}") for k in range(5) for _ in range(k + 1)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = collected(divergence.audited(df, least_docs=4, most_terms=3))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 4, 3)


def test_odd_rows(odd_docs, odd_rows):
    rows = [(text, lang, source) for _, text, lang, source, _ in odd_rows]
    for least in (1, 2, 10):
        got = collected(divergence.audited(odd_docs, least_docs=least))
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, least, 10)


def test_empty_table(no_docs):
    assert divergence.audited(no_docs).collect() == []


def test_copies_are_read_once(odd_docs):
    rows = divergence.collapsed(odd_docs).collect()
    with_text = [r for r in rows if r.text is not None]
    assert len({(r.lang, bytes(r.digest)) for r in rows}) == len(with_text)
    assert sum(r.n for r in rows) == odd_docs.count()


def test_shares_at_the_far_end(spark):
    rows = spark.createDataFrame([(10**15, 10**15, 5), (0, 0, 1)], "n long, total long, v long")
    got = [r[0] for r in rows.select(divergence.share(rows.n, rows.total, rows.v)).collect()]
    assert got == [1 + 10**9 * (10**15 + 2) // (10**15 + 10), 10**9 + 1]
    p, q = np.array([1, 10**9 + 1, 7]), np.array([10**9 + 1, 1, 7])
    assert divergence.difference(p, q).tolist() == [10**18 // (10**9 + 2)] * 2 + [0]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    result = con.execute(oracles.ORACLES["op12_source_divergence"])
    columns = [d[0] for d in result.description]
    want = {tuple(dict(zip(columns, r, strict=True))[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in result.fetchall()}
    assert want
    assert set(collected(queries.QUERIES["op12_source_divergence"](spark, sf_dir))) == want
