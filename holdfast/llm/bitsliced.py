"""Exact top-k inner products on a bit-sliced index.

Components become whole numbers. A block of candidates, in ascending id order, stores bit ``b`` of component
``d`` of all its rows as one bitmap. A query's score is a weighted sum of components, and a weighted sum
of numbers is a sum of shifted bit slices: for each set bit ``j`` of a query component its slices enter at
weight ``b + j`` (complemented for negative ones, which moves all scores by the same constant), and
carry-save adders turn three bitmaps of a weight into one of it and one of the next. The top rows are read
from the most significant slice of the sum downwards: rows with the bit set are in if they are few enough, else
only they stay in question. Rows still equal at the end are equal in score and are taken by id.

Blocks of candidates meet blocks of queries by an equi-join on their numbers; each pair gives at most ``k``
rows per query, merged by a window.

Defined cases: a vector that is null or has a null, NaN or infinite component takes no part, neither does a
row without an id; of several rows with one id the greatest vector counts; shorter vectors end in zeros; an
empty table gives no rows; scores must stay below 2**62, else the job stops with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import settle

SCALE = 256
BLOCK_ROWS = 1 << 15
BLOCK_QUERIES = 128


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and the whole-number components of every vector that takes part, one row per id."""
    good = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.max(vector_col).alias("v"))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    cells = column.combine_chunks()
    lengths = cells.value_lengths().to_numpy(False)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(cells), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = cells.flatten().to_numpy(False)
    return out


def _sliced(table: pa.Table) -> pa.Table:
    """One block of candidates as bit slices of its components less their least value."""
    table = table.sort_by("vec_id")
    values = _matrix(table["v"])
    low = values.min(axis=0)
    offset = (values - low).astype(np.uint64)
    bits = max(int(offset.max(initial=0)).bit_length(), 1)
    rows, width = values.shape
    words = -(-rows // 64)
    slices = np.zeros((width, bits, words * 8), np.uint8)
    for b in range(bits):
        plane = ((offset >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        slices[:, b, : -(-rows // 8)] = np.packbits(plane, axis=1, bitorder="little")
    return pa.table(
        {
            "block": table["block"][:1],
            "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()),
            "low": pa.array([low.tobytes()], pa.binary()),
            "bits": pa.array([bits], pa.int32()),
            "slices": pa.array([slices.tobytes()], pa.binary()),
        }
    )


def _stacked(table: pa.Table) -> pa.Table:
    """One block of queries: ids and their components."""
    values = _matrix(table["v"])
    return pa.table(
        {
            "group": table["group"][:1],
            "query_ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()),
            "queries": pa.array([values.tobytes()], pa.binary()),
        }
    )


def _summed(slices: np.ndarray, bits: int, query: np.ndarray) -> np.ndarray:
    """Slices of the sum of ``|q| * x`` (complement of x for negative q), least significant first.

    ``slices``: the bitmaps of all components, then their complements.
    """
    width = len(query)
    size = np.abs(query).astype(np.uint64)
    places = np.arange(max(int(size.max(initial=0)).bit_length(), 1), dtype=np.uint64)
    at, place = np.nonzero((size[:, None] >> places) & np.uint64(1))
    first = (at + np.where(query[at] < 0, width, 0)) * bits
    index = (first[:, None] + np.arange(bits)).ravel()
    weight = (place[:, None] + np.arange(bits)).ravel()
    order = np.argsort(weight, kind="stable")
    index, weight = index[order], weight[order]
    out, carry, w = [], np.zeros((0, slices.shape[1]), np.uint64), 0
    while w <= int(weight.max(initial=-1)) or len(carry):
        low, high = np.searchsorted(weight, [w, w + 1])
        maps = np.concatenate([slices[index[low:high]], carry]) if len(carry) else slices[index[low:high]]
        nexts = []
        while len(maps) > 2:
            third = len(maps) // 3
            a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
            both = a ^ b
            nexts.append((a & b) | (both & c))
            maps = np.concatenate([both ^ c, maps[3 * third :]])
        if len(maps) == 2:
            nexts.append(maps[:1] & maps[1:])
            maps = maps[:1] ^ maps[1:]
        out.append(maps[0] if len(maps) else np.zeros(slices.shape[1], np.uint64))
        carry = np.concatenate(nexts) if nexts else carry[:0]
        w += 1
    return np.array(out, np.uint64).reshape(-1, slices.shape[1])


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _top(total: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest numbers among the valid ones; of equal numbers the first places."""
    sure, open_ = np.zeros_like(valid), valid
    for plane in total[::-1]:
        ones = open_ & plane
        n = int(np.bitwise_count(sure | ones).sum())
        if n > k:
            open_ = ones
        else:
            sure = sure | ones
            open_ = open_ & ~plane
            if n == k:
                break
    found = _positions(sure)
    return np.concatenate([found, _positions(open_)[: k - len(found)]])


def _searched(ids, low, bits, slices, query_ids, queries, k: int) -> tuple[list, list, list]:
    """(query ids, candidate ids, scores) of one pair of blocks."""
    rows = len(ids)
    words = -(-rows // 64)
    width = len(low)
    slices = slices.reshape(width * bits, words)
    slices = np.concatenate([slices, ~slices])
    everyone = np.zeros(words * 8, np.uint8)
    everyone[: -(-rows // 8)] = np.packbits(np.ones(rows, np.uint8), bitorder="little")
    everyone = everyone.view(np.uint64)
    out: tuple[list, list, list] = ([], [], [])
    for own, query in zip(query_ids, queries, strict=True):
        full = np.zeros(max(width, len(query)), np.int64)
        full[: len(query)] = query
        query = full[:width]
        reach = int(np.abs(query).sum()) * ((1 << bits) + int(np.abs(low).max(initial=0)))
        if reach >= 1 << 62:
            raise ValueError("scores need more than 62 bits; use a smaller scale")
        total = _summed(slices, bits, query)
        valid = everyone
        at = int(np.searchsorted(ids, own))
        if at < rows and ids[at] == own:
            valid = everyone.copy()
            valid[at >> 6] &= ~np.uint64(1 << (at & 63))
        found = _top(total, valid, k)
        plane = (total[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
        units = (plane.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)
        shift = int((query * low).sum()) - ((1 << bits) - 1) * int(-query[query < 0].sum())
        out[0].extend([int(own)] * len(found))
        out[1].extend(ids[found].tolist())
        out[2].extend((units + shift).tolist())
    return out


def nearest(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each row whose id ``query_every`` divides."""
    rows = settle(quantised(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.where(F.col("vec_id") % query_every == 0)
    blocks = rows.count() // block_rows + 1
    sets = asked.count() // block_queries + 1
    index = (
        rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .applyInArrow(_sliced, "block int, ids binary, low binary, bits int, slices binary")
    )
    index = settle(index, "bit-slices").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    groups = (
        asked.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).cast("int"))
        .groupBy("group")
        .applyInArrow(_stacked, "group int, query_ids binary, queries binary")
    )
    groups = settle(groups, "query-blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = index.join(groups, ["block", "group"]).select("ids", "low", "bits", "slices", "query_ids", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, low, bits, slices, own, queries in zip(*batch.columns, strict=True):
                own = np.frombuffer(own.as_buffer(), np.int64)
                found = _searched(
                    np.frombuffer(ids.as_buffer(), np.int64),
                    np.frombuffer(low.as_buffer(), np.int64),
                    bits.as_py(),
                    np.frombuffer(slices.as_buffer(), np.uint64),
                    own,
                    np.frombuffer(queries.as_buffer(), np.int64).reshape(len(own), -1),
                    k,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"]
                )

    best = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
