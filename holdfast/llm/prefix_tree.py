"""Near-duplicates by an exact n-gram Jaccard join over prefix trees.

A document's set holds the hashes of its distinct word n-grams. Two documents link when
``100 * |A & B| >= percent * |A | B|``. The join keeps every link's component and never lists the pairs
of a group of copies:

1. N-gram fingerprints are dealt to tasks by their hash, as blocks of bytes, and counted there. Only documents
   that share ``percent`` of their n-grams with any other document can link; the rest are done.
2. Equal sets become one class. Each class sends the rarest n-grams of its set, so many that two linked
   sets have one in common (prefix filter); classes that meet there form clusters. The n-grams are counted over
   all classes, and those that only one class has need not be sent, so that unlike texts seldom meet.
3. Within a cluster, or between blocks of a large one, the sets go into a prefix tree in one global order,
   the most common n-grams first, so that near copies share long paths. A set walks down the tree with
   the overlap so far; it leaves a subtree when the remaining lengths cannot reach the bound, or when
   all sets there are in its component already.

Large clusters are cut into blocks in order of size. Every block is joined with the next one, which makes one
component of a group of copies; then only such pairs of blocks are joined whose sizes allow links and that
are not one component already. All of this is exact: no partner is left out.

Defined cases: null or blank texts have empty sets and link with nothing; rows of one id count as linked;
a row without an id takes no part and has no component; an empty table gives no rows; other columns are
not read. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import numbered, settle, small_batches, tidy, tidy_group
from holdfast.llm.components import components

WORDS = 5
PERCENT = 75
BLOCK = 512
#: Bytes of a word from which on its hash is a keyed one.
LONG = 64
#: Bits of the filter that is sent to every task of the second reading; 2 MB whatever the input.
FILTER_BITS = 1 << 24
#: N-grams of the classes that one task counts, about.
GRAMS_PER_PART = 1 << 22

U = np.uint64
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_WORD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, all texts at once."""
    raw = [(t or "").encode() for t in texts]
    if not raw:
        return []
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_GAP[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    # hash of a word: sum of its bytes' codes times odd powers of their place in the word
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _STEP))
    codes = _BYTE[data[inside]]
    first = np.cumsum(lengths) - lengths
    codes *= powers[np.arange(len(codes)) - np.repeat(first, lengths)]
    words = _mix(np.add.reduceat(codes, first) + lengths.astype(U)) if len(first) else np.zeros(0, U)
    # such sums are alike for some long words, whatever the codes, so these are hashed otherwise
    for k in np.flatnonzero(lengths > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=b"word").digest()
        words[k] = int.from_bytes(digest, "little")
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    grams = np.zeros(max(len(words) - n + 1, 0), U)
    for k in range(n):
        grams += words[k : len(words) - n + 1 + k] * _WORD[k] if len(grams) else U(0)
    grams = _mix(grams)
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high - low >= n:
            found = np.sort(grams[low : high - n + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif high > low:
            whole = (words[low:high] * _WORD[: high - low]).sum(dtype=U) + U(high - low)
            out.append(_mix(np.array([whole], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(parts)) >> U(32)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(0xFFFFFFFF)).astype("<u4")


def _spread(sets: list[np.ndarray], parts: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """(parts, how many n-grams each set has there, their fingerprints); part 0 is always there."""
    hashes = np.concatenate(sets)
    part = _part(hashes, parts)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    low, owner = _low(hashes)[order], owner[order]
    used = [p for p in range(parts) if cuts[p + 1] > cuts[p] or not p]
    counts = [np.bincount(owner[cuts[p] : cuts[p + 1]], minlength=len(sets)).astype("<u4").tobytes() for p in used]
    return used, counts, [low[cuts[p] : cuts[p + 1]].tobytes() for p in used]


def _dealt(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """part, chunk and, for the documents of a chunk, the sizes and fingerprints of their n-grams there.

    Part 0 also has the documents' ids and the digests of their whole sets.
    """
    kind = docs.schema["doc_id"].dataType

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, most_bytes=2 << 20):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            used, counts, marks = _spread(sets, parts)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            digests = pa.array([digest], pa.list_(pa.binary()))
            none, no_digests = pa.array([None], ids.type), pa.array([None], digests.type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([(task << 32) + serial] * len(used), pa.int64()),
                    pa.concat_arrays([none if p else ids for p in used]),
                    pa.concat_arrays([no_digests if p else digests for p in used]),
                    pa.array(counts, pa.binary()),
                    pa.array(marks, pa.binary()),
                ],
                ["part", "chunk", "ids", "digests", "sizes", "marks"],
            )
            serial += 1

    schema = f"part int, chunk long, ids array<{kind.simpleString()}>, digests array<binary>, sizes binary, marks binary"
    return docs.select("doc_id", "text").mapInArrow(tidy(deal), schema)


def _count_part(table: pa.Table) -> pa.Table:
    """For one part: how many n-grams of each document occur elsewhere."""
    marks = [np.frombuffer(m.as_buffer(), "<u4") for m in table["marks"]]
    every = np.sort(np.concatenate(marks))
    shared = every[1:][every[1:] == every[:-1]]
    shared = shared[np.concatenate([[True], shared[1:] != shared[:-1]])] if len(shared) else shared
    found = []
    for mine, sizes in zip(marks, table["sizes"], strict=True):
        sizes = np.frombuffer(sizes.as_buffer(), "<u4")
        hit = np.zeros(len(mine) + 1, np.int64)
        if len(shared):
            place = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
            np.cumsum(shared[place] == mine, out=hit[1:])
        ends = np.cumsum(sizes, dtype=np.int64)
        found.append((hit[ends] - hit[ends - sizes]).astype("<u4").tobytes())
    return table.select(["chunk", "ids", "digests", "sizes"]).append_column("shared", pa.array(found, pa.binary()))


def _sum_chunk(table: pa.Table) -> pa.Table:
    """For one chunk of documents: digest, size and shared n-grams, added up over the parts."""
    add = lambda name: sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in table[name])
    ids, digests = (next(x.values for x in table[name] if x.is_valid) for name in ("ids", "digests"))
    return pa.table({"doc_id": ids, "digest": digests, "n": pa.array(add("sizes")), "shared": pa.array(add("shared"))})


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """doc_id, n and set of the documents whose id is wanted.

    A bit filter of fixed size over hashed ids keeps most other texts from being shuffled; the join is exact.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = (
        wanted.select((slot + 1).alias("slot"))  # these functions count from 1
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    width = 1 << 12
    for row in bits:
        packed[(row.bucket - 1) * width : row.bucket * width] = np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for batch in batches:
            slots = batch.column(2).to_numpy(False)
            hit = (filter_[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most_bytes=2 << 20):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "hashes"],
            )

    some = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(tidy(keep), f"doc_id {kind}, text string")
    exact = some.join(wanted.select("doc_id"), "doc_id", "left_semi")
    return exact.mapInArrow(tidy(gather), f"doc_id {kind}, n long, hashes binary")


def _needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _weigh_part(table: pa.Table) -> pa.Table:
    """For one part: the n-grams of each set that occur more than once, with the logarithms of their counts."""
    marks = [np.frombuffer(m.as_buffer(), "<u4") for m in table["marks"]]
    _, which, counts = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    weights = np.minimum(8 * np.log2(counts), 255).astype(np.uint8)
    rows, at = [], 0
    for mine, sizes in zip(marks, table["sizes"], strict=True):
        own = which[at : at + len(mine)]
        at += len(mine)
        often = counts[own] > 1
        ends = np.cumsum(np.frombuffer(sizes.as_buffer(), "<u4"), dtype=np.int64)
        kept = np.diff(np.concatenate([[0], np.cumsum(often)])[ends], prepend=0)
        rows.append((kept.astype("<u4").tobytes(), mine[often].tobytes(), weights[own[often]].tobytes()))
    found = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
    table = table.select(["part", "chunk", "ids", "sizes"])
    for name, column in zip(("kept", "marks", "weights"), found, strict=True):
        table = table.append_column(name, column)
    return table


def _prefix_chunk(table: pa.Table, percent: int) -> pa.Table:
    """For one chunk of sets: the first n-grams of each, rare ones first, without those that no other set has."""
    ids = next(x.values for x in table["ids"] if x.is_valid)
    sizes = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in table["sizes"])
    grams, owners = [], []
    for part, kept, marks in zip(table["part"].to_pylist(), table["kept"], table["marks"], strict=True):
        grams.append(np.frombuffer(marks.as_buffer(), "<u4").astype(np.int64) + (part << 32))
        owners.append(np.repeat(np.arange(len(ids)), np.frombuffer(kept.as_buffer(), "<u4")))
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    weight = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["weights"]])
    order = np.lexsort((gram, weight, owner))
    gram, owner = gram[order], owner[order]
    shared = np.bincount(owner, minlength=len(ids))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(shared) - shared, shared)
    # those that only one set has come first of all and use up their places
    first = place <= (shared - _needed(sizes, percent))[owner]
    return pa.table({"gram": gram[first], "doc_id": ids.take(pa.array(owner[first]))})


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """gram, doc_id: the rarest n-grams of each class, so many that linked classes share one.

    Counts are those over all classes, by the hash ranges of the first step. N-grams that only one class has are
    left out, and so is a class that shares too few with others. Those whose fingerprints meet count as one, which
    only brings more classes together.
    """
    spark = classes.sparkSession
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // GRAMS_PER_PART)
    kind = classes.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "hashes", most_bytes=8 << 20):
            sets = [np.frombuffer(cell.as_buffer(), "<u8") for cell in batch.column(1)]
            used, counts, marks = _spread(sets, parts)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            none = pa.array([None], ids.type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([(task << 32) + serial] * len(used), pa.int64()),
                    pa.concat_arrays([none if p else ids for p in used]),
                    pa.array(counts, pa.binary()),
                    pa.array(marks, pa.binary()),
                ],
                ["part", "chunk", "ids", "sizes", "marks"],
            )
            serial += 1

    shape = f"part int, chunk long, ids array<{kind}>, sizes binary, "
    dealt = classes.select("doc_id", "hashes").mapInArrow(tidy(deal), f"{shape}marks binary")
    weighed = settle(
        dealt.groupBy("part").applyInArrow(tidy_group(_weigh_part), f"{shape}kept binary, marks binary, weights binary"),
        "gram-weights",
    )
    first = tidy_group(lambda t: _prefix_chunk(t, percent))
    return weighed.groupBy("chunk").applyInArrow(first, f"gram long, doc_id {kind}")


class Tree:
    """A prefix tree over ordered sets, as runs of the sets in lexical order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.kept = np.array([len(s) for s in self.sets])
        self.joint = np.zeros(len(sets) + 1, np.int64)  # common prefix with the set before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.joint[i] = differ[0] if len(differ) else m
        self._children: dict[tuple[int, int], tuple] = {}

    def node(self, low: int, high: int) -> tuple:
        """(depth where the run's common path ends, its children, least and greatest size and length)."""
        found = self._children.get((low, high))
        if found is None:
            if high - low == 1:
                depth, cuts = int(self.kept[low]), []
            else:
                inner = self.joint[low + 1 : high]
                depth = int(inner.min())
                cuts = [low, *(low + 1 + np.flatnonzero(inner == depth)).tolist(), high]
            children = list(zip(cuts[:-1], cuts[1:], strict=True))
            sizes, kept = self.sizes[low:high], self.kept[low:high]
            found = depth, children, int(sizes.min()), int(sizes.max()), int(kept.max())
            self._children[low, high] = found
        return found


def joined(sets: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups, as many as tie together all that are linked.

    ``sets`` are distinct n-gram numbers in one global order, without those that only one set has;
    ``sizes`` count all n-grams.
    """
    tree = Tree(sets, sizes)
    group = groups[tree.order].copy()
    count = len(sets)
    has = np.zeros(int(max((s[-1] for s in tree.sets if len(s)), default=-1)) + 1, bool)
    links = []
    for probe in range(count):
        mine, size = tree.sets[probe], int(tree.sizes[probe])
        has[mine] = True
        stack = [(0, count, 0, 0)]
        while stack:
            low, high, depth, overlap = stack.pop()
            if high - low == 1 and (low == probe or group[low] == group[probe]):
                continue
            if (group[low:high] == group[probe]).all():
                continue
            end, children, least, most, longest = tree.node(low, high)
            if least * 100 < size * percent and most * 100 < size * percent or least * percent > size * 100:
                continue
            path = tree.sets[low]
            if end > depth:
                overlap += int(np.count_nonzero(has[path[depth:end]]))
            # what the probe has after this place, and what any set below has
            rest = len(mine) - (int(np.searchsorted(mine, path[end - 1], side="right")) if end else 0)
            reach = overlap + min(rest, longest - end)
            # 100 * I >= percent * (size + other - I) for the smallest other below
            if (100 + percent) * reach < percent * (size + least):
                continue
            if high - low == 1:
                other = int(tree.sizes[low])
                if (100 + percent) * overlap >= percent * (size + other):
                    links.append((int(tree.order[probe]), int(tree.order[low])))
                    group[group == group[low]] = group[probe]
                continue
            if not children or end == int(tree.kept[low]):
                # sets that end here are runs of their own
                stop = low + 1
                while stop < high and tree.joint[stop] == end and tree.kept[stop] == end:
                    stop += 1
                for at in range(low, stop):
                    if group[at] != group[probe] and (100 + percent) * overlap >= percent * (size + int(tree.sizes[at])):
                        links.append((int(tree.order[probe]), int(tree.order[at])))
                        group[group == group[at]] = group[probe]
                children = [(a, b) for a, b in children if a >= stop]
            stack.extend((a, b, end, overlap) for a, b in reversed(children))
        has[mine] = False
    return links


def _numbered_sets(cells: list[np.ndarray]) -> list[np.ndarray]:
    """Sets over small numbers, the most common first, without n-grams that only one set has."""
    every = np.concatenate(cells) if cells else np.zeros(0, "<u8")
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    order = np.lexsort((values, -counts))
    rank[order] = np.arange(len(values))
    number, often = rank[inverse], counts[inverse] > 1
    out, at = [], 0
    for cell in cells:
        mine = number[at : at + len(cell)][often[at : at + len(cell)]]
        out.append(np.sort(mine))
        at += len(cell)
    return out


def _meeting(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """A label per set; sets that can link have the same one: the prefix filter with exact counts.

    ``sets`` number the most common n-gram 0 and lack those that only one set has; these come first of all
    in the rarest-first order that the filter takes.
    """
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    grams, owners = [], []
    for i, (own, size) in enumerate(zip(sets, sizes.tolist(), strict=True)):
        first = size - _needed(size, percent) + 1 - (size - len(own))
        if first > 0:
            grams.append(own[::-1][:first])
            owners.append(np.full(len(grams[-1]), i))
    if grams:
        gram, owner = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        near = np.flatnonzero(gram[1:] == gram[:-1])
        pairs = np.unique(np.stack([owner[near], owner[near + 1]]), axis=1)
        for a, b in pairs.T.tolist():
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


def _join_groups(table: pa.Table, percent: int) -> pa.Table:
    """Links within each cluster of the table; sets that share a ``tie`` are in one component already."""
    empty = table.schema.field("doc_id").type
    ids = table["doc_id"].combine_chunks()
    cluster = table["cluster"].to_numpy()
    ties = table["tie"].to_numpy()
    sizes = table["n"].to_numpy()
    cells = [np.frombuffer(x.as_buffer(), "<u8") for x in table["hashes"]]
    order = np.argsort(cluster, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(cluster[order])) + 1, [len(order)]])
    left, right = [], []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[low:high]
        if len(rows) < 2:
            continue
        _, groups = np.unique(ties[rows], return_inverse=True)
        sets = _numbered_sets([cells[r] for r in rows])
        labels = _meeting(sets, sizes[rows], percent)
        order_ = np.argsort(labels, kind="stable")
        ends = np.concatenate([np.flatnonzero(np.diff(labels[order_])) + 1, [len(rows)]])
        for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            some = order_[start:end]
            if len(some) > 1 and len(np.unique(groups[some])) > 1:
                for a, b in joined([sets[k] for k in some], sizes[rows][some], groups[some], percent):
                    left.append(int(rows[some[a]]))
                    right.append(int(rows[some[b]]))
    return pa.table(
        {"u": ids.take(pa.array(left, pa.int64())).cast(empty), "v": ids.take(pa.array(right, pa.int64())).cast(empty)}
    )


def _links(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    members = members.select(*dict.fromkeys([*keys, "cluster", "doc_id", "n", "hashes", "tie"]))
    kind = members.schema["doc_id"].dataType.simpleString()
    return members.groupBy(*keys).applyInArrow(tidy_group(lambda t: _join_groups(t, percent)), f"u {kind}, v {kind}")


def _class_links(classes: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """u, v: links that tie together all classes of a component.

    Where each class goes is worked out on ids and sizes; the sets are shuffled once per step.
    """
    spark = classes.sparkSession
    member = classes.join(clusters, classes["doc_id"] == clusters["node"], "left").select(
        "doc_id", "n", F.coalesce("root", "doc_id").alias("cluster")
    )
    # repeated rows of an id are one member, here as in the blocks below
    sizes = member.groupBy("cluster").agg(F.countDistinct("doc_id").alias("members"))
    member = settle(member.join(sizes.where("members > 1"), "cluster").distinct(), "clusters")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    small = member.where(F.col("members") <= block)
    small = small.select("doc_id", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(buckets)).alias("bucket"))
    small = classes.join(small.distinct(), "doc_id").withColumn("tie", F.col("doc_id"))
    found = settle(_links(small, ["bucket"], percent), "links")
    large = member.where(F.col("members") > block)
    if large.isEmpty():
        return found
    # equal sizes are told apart by a hash, so that ranges of it are even
    by_size = (F.col("n") + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)).alias("size")
    blocks = settle(
        numbered(large.select("cluster", "doc_id", "n", by_size), "cluster", ["size", "doc_id"], "number", ranged=True)
        .select("cluster", "doc_id", "n", F.expr(f"number div {block}").cast("int").alias("block")),
        "blocks",
    )
    # blocks are in order of size: first every block with itself and the next one, a single one with itself
    last = blocks.groupBy("cluster").agg(F.greatest(F.max("block"), F.lit(1)).alias("last"))
    runs = F.filter(F.array(F.col("block") - 1, F.col("block")), lambda p: (p >= 0) & (p < F.col("last")))
    places = blocks.join(last, "cluster").select("cluster", "doc_id", F.explode(runs).alias("pair"))
    placed = classes.join(places.distinct(), "doc_id").withColumn("tie", F.col("doc_id"))
    first = settle(_links(placed, ["cluster", "pair"], percent), "links")
    # then the other pairs of blocks whose sizes allow links, unless they are one component already
    root = components(first)
    tied = settle(
        blocks.join(root, blocks["doc_id"] == root["node"], "left")
        .withColumn("tie", F.coalesce("root", "doc_id"))
        .drop("node", "root"),
        "tied",
    )
    reach = tied.groupBy("cluster", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("tie").alias("low"), F.max("tie").alias("high")
    )
    one, two = reach.alias("a"), reach.alias("b")
    pairs = one.join(two, "cluster").where(
        f"b.block > a.block + 1 and a.most * 100 >= b.least * {percent}"
        " and not (a.low = a.high and b.low = b.high and a.low = b.low)"
    )
    pairs = settle(pairs.select("cluster", F.col("a.block").alias("i"), F.col("b.block").alias("j")), "block-pairs")
    if pairs.isEmpty():
        return found.unionByName(first)
    ends = pairs.withColumn("block", F.explode(F.array("i", "j")))
    places = tied.join(ends, ["cluster", "block"]).select("cluster", "i", "j", "doc_id", "tie").distinct()
    second = settle(_links(classes.join(places, "doc_id"), ["cluster", "i", "j"], percent), "links")
    return found.unionByName(first).unionByName(second)


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = WORDS,
    percent: int = PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ids must be whole numbers."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = settle(
        _dealt(rows, n, parts)
        .groupBy("part")
        .applyInArrow(
            tidy_group(_count_part),
            f"chunk long, ids array<{kind}>, digests array<binary>, sizes binary, shared binary",
        ),
        "gram-counts",
    )
    sizes = settle(
        counted.groupBy("chunk").applyInArrow(tidy_group(_sum_chunk), f"doc_id {kind}, digest binary, n long, shared long"),
        "set-sizes",
    )
    survivors = sizes.where(f"doc_id is not null and n > 0 and shared * 100 >= n * {percent}")
    # classes of equal sets, by their least id
    least = survivors.groupBy("digest").agg(F.min("doc_id").alias("root"))
    copies = survivors.join(least, "digest").where("doc_id <> root")
    copies = settle(copies.select(F.col("doc_id").alias("u"), F.col("root").alias("v")), "copies")
    wanted = settle(least.select(F.col("root").alias("doc_id")).distinct(), "class-ids")
    classes = settle(_sets_of(rows.where("doc_id is not null"), wanted, n), "classes")
    prefixes = settle(_prefixes(classes, percent), "prefixes")
    meet = prefixes.groupBy("gram").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("most")).where("v <> most")
    edges = prefixes.join(meet.select("gram", "v"), "gram").select(F.col("doc_id").alias("u"), "v")
    clusters = settle(components(edges), "cluster-roots")
    links = _class_links(classes, clusters, percent, block).unionByName(copies)
    roots = components(links)
    return (
        sizes.join(roots, sizes["doc_id"] == roots["node"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near-duplicates keeps one: its least id.

    Of several rows with that id the least by all columns stays; rows without an id stay.
    """
    kept = groups(docs, id_col=id_col, **options).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"))
    cells = [(f.dataType.simpleString(), F.col("row").getField(f.name)) for f in docs.schema.fields]
    # maps and variants have no order; their text has
    order = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c for kind, c in cells]
    first = Window.partitionBy("doc_id").orderBy(*order)
    found = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
    return found.unionByName(docs.where(F.col(id_col).isNull()))
