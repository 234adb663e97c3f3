"""Mixing sources to target weights by Pfair scheduling of their blocks.

Documents of a source are numbered and put into blocks of ``block_docs``. With ``w`` of ``parts`` as its
weight, block ``i`` of a source is released at slot ``floor(i * parts / w)`` and due by
``ceil((i + 1) * parts / w)``. One block runs per slot, the released one with the earliest deadline; on one
resource this meets every deadline, so after any number of slots each source is less than one block away
from its share. The schedule repeats after ``parts`` slots, so only one period is worked out and a block's
slot is plain arithmetic. When a source has no blocks left, the others go on by their weights in a new
phase: every document is placed exactly once.

Defined cases: a null source is a source of its own; sources without a weight, or with one that is not
positive, follow after all others in equal shares; equal rows get places of their own; an empty table
gives no rows. There may be at most ``parts`` sources, which bounds the plan that each task gets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from holdfast.llm.common import numbered, settle

PARTS = 1000
_PLACE = [StructField("block", LongType()), StructField("slot", LongType())]


def shares(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """Whole-number weights that sum to ``parts``, at least 1 each, by largest remainders."""
    total = sum(weights.values())
    free = parts - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    late = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in late[: parts - sum(out.values())]:
        out[s] += 1
    return out


def period(weights: Mapping[str, int]) -> dict[str, np.ndarray]:
    """Slots of each source within one period: earliest deadline first among released blocks."""
    parts = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for t in range(parts):
        ready = [(-(-(done[s] + 1) * parts // w), s) for s, w in weights.items() if done[s] * parts // w <= t]
        _, s = min(ready)
        slots[s].append(t)
        done[s] += 1
    return {s: np.array(x, np.int64) for s, x in slots.items()}


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], parts: int = PARTS) -> list[dict]:
    """What holds between one source's end and the next: first slot, period, and each source's blocks so far."""
    left = {s: n for s, n in blocks.items() if n}
    taken = dict.fromkeys(left, 0)
    out, begin = [], 0
    while left:
        weighted = {s: weights[s] for s in left if weights.get(s, 0) > 0}
        own = shares(weighted or dict.fromkeys(left, 1.0), parts)
        slots = period(own)
        ends = {s: (left[s] - 1) // w * parts + int(slots[s][(left[s] - 1) % w]) + 1 for s, w in own.items()}
        length = min(ends.values())
        out.append({"begin": begin, "slots": slots, "taken": dict(taken)})
        for s, w in own.items():
            n = length // parts * w + int(np.searchsorted(slots[s], length % parts))
            taken[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        begin += length
    return out


def slot_of(plan: list[dict], source: str, block: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Slot of each block of a source."""
    own = [p for p in plan if source in p["slots"]]
    firsts = np.array([p["taken"][source] for p in own])
    which = np.searchsorted(firsts, block, side="right") - 1
    out = np.empty(len(block), np.int64)
    for k in np.unique(which):
        mine = which == k
        slots = own[k]["slots"][source]
        rounds, nth = np.divmod(block[mine] - firsts[k], len(slots))
        out[mine] = own[k]["begin"] + rounds * parts + slots[nth]
    return out


def key_of(source: str | None) -> str:
    return "-" if source is None else f"={source}"


def mixed(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = 64,
    parts: int = PARTS,
) -> DataFrame:
    """Each row of ``docs`` (a written table) as ``row``, with its ``block`` within the source and its ``slot``.

    Without ``weights`` each source weighs the square root of its documents. Documents of a source are
    numbered within hashed parts, so a source that holds most rows is numbered by many tasks.
    """
    source = F.col(source_col)
    keyed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("key"),
    )
    counts = {r.key: r.n for r in keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).limit(parts + 1).collect()}
    if len(counts) > parts:
        raise ValueError(f"more than {parts} sources; raise parts")
    target = {k: n**0.5 for k, n in counts.items()} if weights is None else {key_of(s): w for s, w in weights.items()}
    blocks = {k: -(-n // block_docs) for k, n in counts.items()}
    shared = docs.sparkSession.sparkContext.broadcast(phases(blocks, target, parts))
    placed = numbered(keyed, "key", ["doc_id"], "number").select("row", "key", "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            block = batch.column(2).to_numpy(False) // block_docs
            keys = batch.column(1).dictionary_encode()
            code = keys.indices.to_numpy(False)
            slot = np.empty(len(block), np.int64)
            for k, key in enumerate(keys.dictionary.to_pylist()):
                slot[code == k] = slot_of(plan, key, block[code == k], parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(block), pa.array(slot)], ["row", "block", "slot"]
            )

    return placed.mapInArrow(place, StructType([placed.schema["row"], *_PLACE]))


def interleaved(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (a written table) with their own columns, in the order of the mix.

    Written as Parquet, part files and the rows in them are in that order; ``common.written_place`` reads it back.
    """
    placed = mixed(docs, **options)
    id_col = options.get("id_col", "doc_id")
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", F.col("row")[id_col]).select("row.*")


def schedule(docs: DataFrame, id_col="doc_id", source_col="source", **options) -> DataFrame:
    """doc_id, source, block and slot of every document; only ids and sources are read and shuffled."""
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")), "mix-rows")
    return mixed(rows, **options).select("row.doc_id", "row.source", "block", "slot")
