"""The trie of conversations against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from holdfast.llm import oracles, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, box string, next string"


def tid(role, text):
    whole = f"{len(role)}:{role}{text}".encode()
    return hashlib.sha256(whole).digest()[:16]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, tid(role, text), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(p[-1][1].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).replace(" ", "\n").split("\n")) if p else 0
        words -= sum(1 for w in p[-1][1].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if not w) if p else 0
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children[p])
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in own if whole[c] == p)
        parent = members[p[:-1]][0] if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((own[0], len(p), parent, len(own), len(children[p]), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def made(seed, convs, kinds, longest):
    """Conversations with long shared beginnings, copies, ties, gaps, nulls and repeated rows."""
    rng = random.Random(seed)
    shared = [[("user", f"w{rng.randint(0, kinds)} x") for _ in range(longest)] for _ in range(3)]
    rows = []
    for c in rng.sample(range(-40, convs), convs):
        begin = rng.choice(shared)[: rng.choice([0, 1, 2, longest // 2, longest, longest])]
        rest = [(rng.choice(["user", None, ""]), rng.choice([None, "", "a b\tc", "\x0b d "])) for _ in range(rng.randint(0, 3))]
        for k, (role, text) in enumerate(begin + rest):
            rows.append((c, rng.choice([k, k, k, None]) if rng.random() < 0.2 else 10 * k, role, text, "own", "own"))
    return [*rows, *rows[:3], (None, 0, "user", "no id", None, None)]


@pytest.mark.parametrize(
    ("segment", "most", "longest"),
    [(1024, 2000, 6), (1024, 3, 6), (4, 2000, 9), (4, 3, 9), (3, 1, 13), (5, 8, 23)],
)
def test_equals_brute_force(spark, monkeypatch, segment, most, longest):
    monkeypatch.setattr(prefix_trie, "IDS_PER_ROW", 2)
    monkeypatch.setattr(prefix_trie, "ROWS_PER_PART", 50)
    rows = made(segment + most, 60, 2, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [tuple(r) for r in prefix_trie.nodes(df, segment, most).collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[(7, 0, "user", "one")], [(3, 0, "a", "b"), (3, 0, "a", "b")], [(40, t, "u", "x y") for t in range(9)] + [(41, 0, "u", "q")]])
def test_few_rows(spark, rows):
    rows = [(*r, None, None) for r in rows]
    for segment in (1024, 3):
        got = [tuple(r) for r in prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA), segment).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    result = con.execute(oracles.ORACLES["op13_prefix_trie"])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES["op13_prefix_trie"](spark, sf_dir)
    want = sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in df.columns) for r in result.fetchall()), key=str)
    assert want
    assert sorted(map(tuple, df.collect()), key=str) == want
