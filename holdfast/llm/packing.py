"""Best-fit packing of documents into training sequences after dominance reduction.

Documents are tokenized and cut into pieces of at most ``capacity`` ids; a piece is placed by its length
alone, so the instance is a histogram of at most ``capacity`` lengths however many documents there are.
On it, Martello and Toth's dominance criterion fixes for the longest length the one feasible set that is
provably as good as any other (its exact complement; alone if nothing fits; the longest partner if no two
others fit, or if it is at least as long as the best two that do). What no set dominates is packed best
fit, longest first, many equal pieces at a time. Pieces are then numbered within their length and look up
their sequence and offset in the plan.

Packed in order (``packed_in_order``), the pieces are dealt to windows of about ``WINDOW`` that follow each other
in the order of the documents, and each window is an instance of its own, packed by one task: so a sequence holds
pieces of one window, sequence ids follow the windows, and inside a window the places of pieces in it.

Defined cases: null text is an empty document and still has its end id; equal rows get places of their
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import numbered, range_part, settle, small_batches, tidy
from holdfast.llm.tokens import BATCH, encoder

#: Pieces that are packed at once where sequences follow the order of the documents.
WINDOW = 1 << 17

#: (lengths and how often each, in order of place) and the number of sequences filled so
Pattern = tuple[tuple[tuple[int, int], ...], int]


def cut(
    docs: DataFrame,
    path: str,
    capacity: int,
    end_id: int,
    id_col="doc_id",
    text_col="text",
    keep_ids=True,
    place_col: str | None = None,
    added: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, and place) of every piece; only longer documents are cut."""
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    rows = docs.select(*columns, *([] if place_col is None else [F.col(place_col).cast("long").alias("place")]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, added)
        for batch in small_batches(batches, most_bytes=BATCH):
            at, number, start, length, crc, kept = [], [], [], [], [], []
            flat, counts = words.encode_all(batch.column(1).to_pylist())
            for row, own in enumerate(np.split(flat.astype("<u4"), np.cumsum(counts)[:-1])):
                ids = np.concatenate([own, end])
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity].tobytes()
                    at.append(row)
                    number.append(k // capacity)
                    start.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    kept.append(part if keep_ids else None)
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            if place_col is not None:
                columns.append(batch.column(2).take(pa.array(at, pa.int64())))
                names.append("place")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    schema += "" if place_col is None else ", place long"
    return rows.mapInArrow(tidy(pieces), schema)


class _Sizes:
    """Lengths still to be packed, with their counts, and the longest one up to a limit."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for size, count in counts.items():
            self.n[size] += count

    def most(self, limit: int, without: tuple[int, ...] = ()) -> int:
        """Longest length up to ``limit`` once the given pieces are taken out; 0 if there is none."""
        for size in without:
            self.n[size] -= 1
        found = np.flatnonzero(self.n[: max(limit, 0) + 1] > 0)
        for size in without:
            self.n[size] += 1
        return int(found[-1]) if len(found) else 0

    def least(self, k: int, without: int) -> list[int]:
        """The ``k`` shortest pieces besides one of length ``without``; fewer if there are fewer."""
        self.n[without] -= 1
        found: list[int] = []
        for size in np.flatnonzero(self.n > 0)[:k]:
            found += [int(size)] * min(int(self.n[size]), k - len(found))
            if len(found) == k:
                break
        self.n[without] += 1
        return found


def _dominating(sizes: _Sizes, size: int, capacity: int) -> tuple[int, ...] | None:
    """The feasible set with one piece of this length that dominates all others, if one is provable."""
    room = capacity - size
    partner = sizes.most(room, (size,))
    if not partner:
        return (size,)
    if partner == room:
        return (size, partner)
    shortest = sizes.least(3, size)
    if len(shortest) < 2 or shortest[0] + shortest[1] > room:
        return (size, partner)
    if len(shortest) == 3 and sum(shortest) <= room:
        return None
    # at most two others fit: one long partner dominates if it is as long as the best pair
    best = 0
    for first in map(int, np.flatnonzero(sizes.n[: room + 1] > 0)):
        if first == size and sizes.n[size] < 2:
            continue
        second = sizes.most(room - first, (size, first))
        best = max(best, first + second if second else 0)
    return (size, partner) if partner >= best else None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(fixed patterns, counts left): sets that dominate are fixed, longest length first, until none is left."""
    sizes = _Sizes(counts, capacity)
    fixed: dict[tuple[int, ...], int] = defaultdict(int)
    changed = True
    while changed:
        changed = False
        for size in map(int, np.flatnonzero(sizes.n > 0)[::-1]):
            while sizes.n[size] > 0 and (found := _dominating(sizes, size, capacity)):
                # pieces only get fewer, so the set dominates as long as its own pieces last
                times = int(sizes.n[size]) // 2 if len(found) == 2 and found[1] == size else int(sizes.n[list(found)].min())
                for piece in found:
                    sizes.n[piece] -= times
                fixed[found] += times
                changed = True
    patterns = [(tuple(sorted(_tally(found).items(), reverse=True)), times) for found, times in fixed.items()]
    return patterns, {int(s): int(sizes.n[s]) for s in np.flatnonzero(sizes.n > 0)}


def _tally(pieces: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for piece in pieces:
        out[piece] += 1
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, on counts: each step fills many equal sequences with equal pieces."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, how many]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        rooms = sorted(r for r, group in open_.items() if r >= size and group)
        moved: list[tuple[int, list]] = []
        for room in rooms:
            each = room // size
            while left and open_[room]:
                pattern, times = open_[room].pop()
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                if full:
                    moved.append((room - each * size, [(*pattern, (size, each)), full]))
                    left -= full * each
                if rest and full < times:
                    moved.append((room - rest * size, [(*pattern, (size, rest)), 1]))
                    left -= rest
                    full += 1
                if full < times:
                    open_[room].append([pattern, times - full])
            if not left:
                break
        each = capacity // size
        if left // each:
            moved.append((capacity - each * size, [((size, each),), left // each]))
        if left % each:
            moved.append((capacity - left % each * size, [((size, left % each),), 1]))
        for room, group in moved:
            open_[room].append(group)
    return [(pattern, times) for groups in open_.values() for pattern, times in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every piece exactly once."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of places by length: pieces numbered from ``first`` on go, ``each`` per sequence, to ``sequence``.."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rows.append((size, taken[size], sequence, each, offset))
            taken[size] += each * times
            offset += size * each
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("size", "first", "sequence", "each", "offset"), table.T, strict=True))


def placed(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` (a written table with ``length``) with sequence_id and offset.

    The histogram has at most ``capacity`` rows, and the plan at most a few runs per length, which bounds
    what the driver holds and what each task gets.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    ranked = numbered(pieces, "length", order, "_number")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        span = np.int64(1) << 40
        starts = runs["size"] * span + runs["first"]
        for batch in batches:
            size = batch.column(names.index("length")).to_numpy(False)
            number = batch.column(len(names)).to_numpy(False)
            run = np.searchsorted(starts, size * span + number, side="right") - 1
            nth, inside = np.divmod(number - runs["first"][run], runs["each"][run])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array(runs["sequence"][run] + nth),
                    pa.array(runs["offset"][run] + inside * size),
                ],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names)
    return ranked.select(*names, "_number").mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def packed(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col="doc_id",
    text_col="text",
    keep_ids=True,
    added: bool = False,
) -> DataFrame:
    """One row per piece with its sequence and offset; texts are read and tokenized once."""
    pieces = settle(cut(docs, path, capacity, end_id, id_col, text_col, keep_ids, added=added), "pieces")
    return placed(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"])


def _spread(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, share, sequence, offset) of every place; the sequences of a pattern are spread evenly over 0 to 1."""
    cells, sequence = [], 0
    for pattern, times in patterns:
        nth = np.arange(times)
        offset = 0
        for size, each in pattern:
            offsets = np.tile(offset + np.arange(each) * size, times)
            share = np.repeat((nth + 0.5) / times, each)
            cells.append((np.full(times * each, size), share, np.repeat(sequence + nth, each), offsets))
            offset += size * each
        sequence += times
    return tuple(np.concatenate(x) for x in zip(*cells, strict=True))


def in_order(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given in their order; sequences are numbered in the order of what they hold.

    Equal pieces go in order to places that are spread over the whole, so that the pieces of a sequence stand
    near each other; a sequence stands at the mean place of its ids.
    """
    values, counts = np.unique(length, return_counts=True)
    size, share, sequence, offset = _spread(plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity))
    pieces = np.argsort(length, kind="stable")
    places = np.lexsort((offset, sequence, share, size))
    own, at = np.empty_like(sequence), np.empty_like(offset)
    own[pieces], at[pieces] = sequence[places], offset[places]
    mean = np.bincount(own, length * np.arange(len(length))) / np.bincount(own, length)
    number = np.empty(len(mean), np.int64)
    number[np.argsort(mean, kind="stable")] = np.arange(len(mean))
    return number[own], at


def packed_in_order(
    docs: DataFrame,
    path: str,
    place_col: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col="doc_id",
    text_col="text",
    window: int = WINDOW,
    added: bool = False,
) -> DataFrame:
    """One row per piece with its sequence and offset; sequence ids follow the documents' order of ``place_col``."""
    pieces = settle(cut(docs, path, capacity, end_id, id_col, text_col, False, place_col, added), "pieces")
    names = [c for c in pieces.columns if c != "place"]
    dealt = pieces.withColumn("_window", range_part(pieces, "place", pieces.count() // window + 1))
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names)

    def pack(table: pa.Table) -> pa.Table:
        keys = ["place", "doc_id", "piece", "start", "ids_crc32"]
        table = table.take(pa.compute.sort_indices(table, [(c, "ascending") for c in keys]))
        sequence, offset = in_order(table["length"].to_numpy().astype(np.int64), capacity)
        columns = [*[table[c] for c in names], table["_window"], pa.array(sequence), pa.array(offset)]
        return pa.table(columns, [*names, "_window", "_sequence", "offset"])

    schema = f"{kinds}, _window int, _sequence long, offset long"
    rows = settle(dealt.groupBy("_window").applyInArrow(pack, schema), "windows")
    sizes = rows.groupBy("_window").agg((F.max("_sequence") + 1).alias("_n"))
    before = Window.orderBy("_window").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_window", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    found = rows.join(F.broadcast(firsts), "_window")  # one row per window
    return found.select(*names, (F.col("_first") + F.col("_sequence")).alias("sequence_id"), "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids of each packed sequence; a group holds at most one sequence."""
    cells = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(cells, lambda c: c["ids"]), ""))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
