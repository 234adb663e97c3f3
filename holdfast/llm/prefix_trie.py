"""Prefix trie of conversations by distributed burst tries.

A turn (role and text) is an id of 128 bits of SHA-256, and a conversation a sequence of ids. Sequences are cut in
segments of at most ``segment`` ids, so that no row holds a whole long conversation; segments with the same ids
before them are one class, named by a hash chained over those ids, and equal segments of a class are collapsed to one
row with a count, so copies of a conversation cost one. Each class is a burst trie: its sequences are suffixes in a
container under a trie head; a container with more than ``most_turns`` turns is burst by the next turn id, its head
becomes a node, and its suffixes go to a container per id. The containers that remain are dealt to shards, sorted, and
each is swept once into nodes, in the memory of one container. Sums over a subtree are those of the container, and
of the containers below for heads; the deepest class of segments comes first. Classes that only copies of one
conversation reach need no such order: what lies below them is a running total of its words.

The rounds of bursting follow the turns that more sequences share than fit a container; those of classes follow the
longest common beginning of two different conversations, in segments.

Defined cases: turns are ordered by ``turn`` with nulls first, equal ones by the id of role and text; null role or
text counts as empty; rows without a conversation id belong to none and are left out; equal rows are turns of their
own; remainders of negative ids have the sign of the id; an empty table has no nodes, not even a root; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import crc32_of, settle

#: Turns of one row at most.
SEGMENT = 1024
#: Turns of a container that is not burst.
MOST_TURNS = 2_000
#: Rows of a task that sorts.
ROWS_PER_PART = 100_000
#: Member ids in one row on the way to a node's digest.
IDS_PER_ROW = 4096
SALTS = 64

#: A conversation takes up to three turns from the one its id, rounded down to this multiple, names.
SHARED = 20
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, words) of every turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("tid"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def _parts(df: DataFrame) -> int:
    return max(df.count() // ROWS_PER_PART + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, tid, words) of the rebuilt turns, (conv_id, length) of all conversations, turnless ones too).

    Turns are sorted in ranges, so that one conversation may fill many tasks; a run of a conversation within a
    range knows how many of its turns lie before.
    """
    found = turns(conversations).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid")]
    dealt = found.repartitionByRange(_parts(conversations), *keys, F.col("_tie")).sortWithinPartitions(*keys)
    dealt = dealt.select("conv_id", "tid", "words", F.monotonically_increasing_id().alias("_at"))
    dealt = settle(dealt, "trie-turns").withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    own = runs.groupBy("conv_id").agg(F.sum("_n").alias("own"))
    lender = own.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    own = own.withColumn("h", crc32_of(F.col("conv_id")) % 4)
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).join(lender, "base", "left")
    own = own.withColumn("m", F.least("h", F.coalesce("lent", F.lit(0))))
    own = own.withColumn("length", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = settle(own.select("conv_id", "base", "h", "m", "length"), "trie-conversations")

    runs = runs.join(convs.select("conv_id", "h", "m"), "conv_id")
    rows = dealt.join(runs, ["conv_id", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    kept = rows.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "tid", "words")
    lent = rows.where((F.col("pos") < 3) & (F.col("conv_id") % SHARED == 0))
    lent = lent.groupBy(F.col("conv_id").alias("base")).agg(  # three turns of a conversation at most
        F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("lent")
    )
    taken = convs.where("m > 0").join(lent, "base")
    taken = taken.select("conv_id", F.explode(F.slice("lent", F.lit(1), F.col("m").cast("int"))).alias("x"))
    return kept.unionByName(taken.select("conv_id", "x.*")), convs.select("conv_id", "length")


def _chained(pieces: DataFrame) -> DataFrame:
    """Segments of a conversation with the key of all ids before each, and of those up to its end."""
    columns = "conv_id long, seg long, tids array<binary>, words array<long>"
    added = ", head binary, next binary, top_words long, before long"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, key, top, total = None, b"", 0, 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, seg, tids, words in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if conv != last:
                    last, key, top, total = conv, b"", 0, 0
                after = hashlib.sha256(b"%d:" % seg + key + b"".join(tids)).digest()[:16]
                for column, value in zip(out, (key, after, top, total), strict=True):
                    column.append(value)
                key, total = after, total + sum(words)
                top = words[-1] if words else top
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "head", "next", "top_words", "before"])

    ordered = pieces.select("conv_id", "seg", "tids", "words").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(chain, columns + added)


def segments(rows: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """Rebuilt conversations in rows of at most ``segment`` turns; each ends with a row of fewer, maybe none."""
    at = F.col("pos") % segment
    parts = rows.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct(at.alias("o"), "tid", "words"))).alias("x")
    )
    parts = parts.select("conv_id", "seg", F.col("x.tid").alias("tids"), F.col("x.words").alias("words"))
    ends = convs.where(F.col("length") % segment == 0).select(
        "conv_id",
        F.floor(F.col("length") / segment).alias("seg"),
        F.expr("cast(array() as array<binary>)").alias("tids"),
        F.expr("cast(array() as array<bigint>)").alias("words"),
    )
    return _chained(parts.unionByName(ends))


def member_digests(endings: DataFrame) -> DataFrame:
    """(next, ends): digest of the members' ids, ascending and comma-joined, for each place where some end.

    Ids are sorted in ranges and joined to texts of ``IDS_PER_ROW`` ids there; a place's texts, in order, then
    pass one running digest, so a place of very many members needs no memory for them.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            values = [pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(values, ["next", "least", "ids"])

        for batch in batches:
            out = []
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (own != key or len(ids) == IDS_PER_ROW):
                    out.append(row())
                    ids = []
                key = own
                ids.append(conv)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch_of(found: list) -> pa.RecordBatch:
            keys, values = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values)], ["next", "ends"])

        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([(key, state.hexdigest())])

    rows = endings.select("next", "conv_id")
    sorted_ids = rows.repartitionByRange(_parts(endings), "next", "conv_id").sortWithinPartitions("next", "conv_id")
    joined = sorted_ids.mapInArrow(texts, "next binary, least long, ids string")
    return joined.repartition("next").sortWithinPartitions("next", "least").mapInArrow(digest, "next binary, ends string")


_SWEPT = (
    "conv_id long, seg long, at long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, box binary, link binary, heads array<binary>"
)


def _swept(rows: DataFrame, segment: int) -> DataFrame:
    """Nodes of all containers; a row with ``link`` stands for the beginning of that class of segments instead."""
    names = [f.split(" ")[0] for f in _SWEPT.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
    read = ["box", "at", "up", "heads", "seg", "tids", "words", "top_words", "n", "conv", "ends", "next", "leaves", "saved"]

    def nodes(own: list[tuple]) -> list[tuple]:
        """Nodes of one container, from its sequences in order."""
        box, top, up, heads, seg = own[0][:5]
        first_words = own[0][6][top - 1] if top else own[0][7]
        depth, parent, words = [top], [-1], [first_words]
        n, conv, ends, leaves, saved, link = [0], [None], [None], [0], [0], [None]
        path, last = [0], []
        for _, _, _, _, _, tids, counts, _, members, least, ended, key, below, gain in own:
            same = top
            while same < len(last) and same < len(tids) and last[same] == tids[same]:
                same += 1
            del path[same - top + 1 :]
            for o in range(same, len(tids)):
                path.append(len(depth))
                depth.append(o + 1)
                parent.append(path[-2])
                words.append(counts[o])
                n.append(0)
                conv.append(None)
                ends.append(None)
                leaves.append(0)
                saved.append(0)
                link.append(None)
            at, last = path[-1], tids
            n[at] += members
            conv[at] = least if conv[at] is None else min(conv[at], least)
            if len(tids) == segment:
                link[at], leaves[at], saved[at] = key, below, gain
            else:
                ends[at] = ended
        children = [0] * len(depth)
        for k in range(len(depth) - 1, -1, -1):
            if link[k] is None:
                saved[k] += (n[k] - 1) * words[k]
                leaves[k] = leaves[k] or 1
            p = parent[k]
            if p >= 0:
                children[p] += 1
                n[p] += n[k]
                conv[p] = conv[k] if conv[p] is None else min(conv[p], conv[k])
                leaves[p] += leaves[k]
                saved[p] += saved[k]
        return [
            (conv[k], seg, depth[k], up if parent[k] < 0 else conv[parent[k]], n[k], children[k], leaves[k], saved[k])
            + (ends[k], box if parent[k] < 0 else None, link[k], heads if parent[k] < 0 else None)
            for k in range(len(depth))
        ]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        found: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(len(read))], strict=True):
                if own and own[0][0] != row[0]:
                    found += nodes(own)
                    own = []
                    if len(found) > 20_000:
                        yield batch_of()
                        found = []
                own.append(row)
        if own:
            found += nodes(own)
        if found:
            yield batch_of()

    return rows.select(read).repartition("box").sortWithinPartitions("box", "tids").mapInArrow(sweep, _SWEPT)


def _burst(rows: DataFrame, most_turns: int, root: Column) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows whose containers stay, heads of the burst ones); containers that ``root`` holds for always burst."""
    stay, heads = [], []
    while True:
        ended = F.size("tids") == F.col("at")
        own_words = F.when(F.col("at") == 0, F.col("top_words")).otherwise(F.col("words")[F.col("at") - 1])
        following = F.when(~ended, F.col("tids")[F.col("at")])
        sizes = rows.groupBy("box").agg(F.sum(F.size("tids") - F.col("at") + 1).alias("size"))
        big = settle(sizes.where((F.col("size") > most_turns) | root).select("box"), "trie-burst")
        if big.isEmpty():
            return [*stay, rows], heads
        salt = F.pmod(F.xxhash64("next"), F.lit(SALTS))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        many = big.select("box", every.alias("_salt"), F.lit(True).alias("_big"))
        marked = rows.withColumns({"_salt": salt, "_next": following, "_words": own_words, "_ended": ended})
        marked = settle(marked.join(many, ["box", "_salt"], "left").drop("_salt"), "trie-rows")
        opened = marked.where("_big")
        top = opened.groupBy("box").agg(
            F.first("seg").alias("seg"),
            F.first("at").alias("at"),
            F.first("up").alias("up"),
            F.first("heads").alias("heads"),
            F.max("_words").alias("words"),
            F.max(F.when(F.col("_ended"), F.col("ends"))).alias("ends"),
            F.min("conv").alias("conv"),
            F.sum("n").alias("n"),
        )
        kinds = opened.select("box", "_next").distinct().groupBy("box").agg(F.count("_next").alias("children"))
        top = settle(top.join(kinds, "box"), "trie-heads")
        heads.append(top)
        stay.append(marked.where("_big is null").drop("_big", "_next", "_words", "_ended"))
        least = top.select("box", F.col("conv").alias("_least"), every.alias("_salt"))
        moved = opened.where("not _ended").withColumn("_salt", salt).join(least, ["box", "_salt"])
        rows = moved.withColumns(
            {
                "up": F.col("_least"),
                "heads": F.concat("heads", F.array("box")),
                "box": F.unhex(F.substring(F.sha2(F.concat("box", "_next"), 256), 1, 32)),
                "at": F.col("at") + 1,
            }
        ).drop("_big", "_next", "_words", "_ended", "_salt", "_least")
        rows = settle(rows, "trie-rows")


def _tries(rows: DataFrame, segment: int, most_turns: int) -> DataFrame:
    """Nodes of the burst tries of all given classes."""
    nothing = F.expr("cast(array() as array<binary>)")
    start = {"box": F.col("head"), "at": F.lit(0).cast("long"), "up": F.lit(None).cast("long"), "heads": nothing}
    root = F.length("box") == 0
    stay, heads = _burst(rows.withColumns(start).drop("head"), most_turns, root)
    found = settle(_swept(reduce(DataFrame.unionByName, stay), segment), "trie-swept")
    if not heads:
        return found
    every = reduce(DataFrame.unionByName, heads)
    own = (F.col("n") - 1) * F.col("words")
    alone = (F.col("children") == 0).cast("long")
    below = found.where(F.size("heads") > 0).select(
        F.explode("heads").alias("box"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")
    )
    above = every.select(F.explode(F.concat("heads", F.array("box"))).alias("box"), alone.alias("l"), own.alias("s"))
    sums = below.unionByName(above).groupBy("box").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    tops = every.join(sums, "box").select(
        F.col("conv").alias("conv_id"),
        "seg",
        "at",
        F.col("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("l").alias("n_leaves"),
        F.col("s").alias("saved_tokens"),
        "ends",
        "box",
        F.lit(None).cast("binary").alias("link"),
        "heads",
    )
    return found.unionByName(tops)


def nodes(conversations: DataFrame, segment: int = SEGMENT, most_turns: int = MOST_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    segs = settle(segments(*rebuilt(conversations), segment), "trie-segments")
    ending = F.size("tids") < segment
    ends = settle(member_digests(segs.where(ending)), "trie-ends")
    same = segs.groupBy("seg", "head", "next").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv"),
        F.first("tids").alias("tids"),
        F.first("words").alias("words"),
        F.first("top_words").alias("top_words"),
    )
    same = same.join(ends, "next", "left")
    none = F.lit(None).cast("long")
    last = segs.agg(F.max("seg")).first()[0]
    if not last:  # no conversation fills a segment
        found = _tries(same.withColumns({"leaves": none, "saved": none}), segment, most_turns)
        return _named(found, segment)

    whole = segs.where(ending).select(
        "conv_id", F.col("next").alias("whole"), (F.col("before") + F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")
    )
    classes = segs.where("seg > 0").join(whole, "conv_id").groupBy("seg", "head").agg(
        (F.min("whole") == F.max("whole")).alias("solo"),
        ((F.count(F.lit(1)) - 1) * F.max(F.col("top_words") + F.col("total") - F.col("before"))).alias("saved"),
    )
    classes = settle(classes, "trie-classes")
    one = F.lit(1).cast("long")
    after = classes.where("solo").select(F.col("head").alias("next"), one.alias("leaves"), "saved")
    rows = same.join(classes.select("seg", "head", "solo"), ["seg", "head"], "left")
    rows = settle(rows.join(after, "next", "left"), "trie-rows")
    solo = rows.where("solo").drop("solo")
    found = [_tries(solo, segment, most_turns)]
    shared = rows.where("solo is null or not solo").drop("solo")
    below: DataFrame | None = None
    for level in range(shared.agg(F.max("seg")).first()[0], -1, -1):
        here = shared.where(F.col("seg") == level)
        if below is not None:
            known = below.where("at = 0 and link is null").select(
                F.col("box").alias("next"), F.col("n_leaves").alias("_l"), F.col("saved_tokens").alias("_s")
            )
            here = here.join(known, "next", "left").withColumns(
                {"leaves": F.coalesce("leaves", "_l"), "saved": F.coalesce("saved", "_s")}
            )
            here = here.drop("_l", "_s")
        below = settle(_tries(here, segment, most_turns), "trie-level")
        found.append(below)
    return _named(reduce(DataFrame.unionByName, found), segment)


def _named(found: DataFrame, segment: int) -> DataFrame:
    """The nodes; the beginning of a class gets its parent from the segment before."""
    links = found.where("link is not null").select(F.col("link").alias("box"), F.col("parent_conv_id").alias("_up"))
    inner = found.where("link is null")
    starts = inner.where("at = 0 and seg > 0").join(links, "box").withColumn("parent_conv_id", F.col("_up")).drop("_up")
    every = inner.where("at > 0 or seg = 0").unionByName(starts)
    return every.select(
        "conv_id",
        (F.col("seg") * segment + F.col("at")).alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
