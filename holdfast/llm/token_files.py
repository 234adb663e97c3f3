"""Token files: frequency-ranked ids in byte-aligned variable-length codes with separate control bytes.

Ids are renumbered by falling frequency, so that common ones take one byte. Each document's ranks are
stored as two byte strings: two control bits per id (bytes it takes, less one) and the data bytes. A
control byte is looked up in a 256-row table to find the lengths of four ids at once, and numpy gathers
the data bytes. Files are Parquet in ascending ``doc_id`` order, next to the rank table.

Defined cases: null text encodes as empty and still gets the end id; null ids come first; rows of one
id stand in the order of their size and bytes; an empty table gives empty files; ids up to 2**32 - 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import range_part, running_total, settle, small_batches
from holdfast.llm.tokens import BATCH, encoder
from holdfast.session import shared_folder

#: bytes of each of the four ids that a control byte describes
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    width = int(code.max(initial=0)) + 1
    cells = values.view(np.uint8).reshape(-1, 4)[:, :width]
    return control.astype(np.uint8).tobytes(), cells[np.arange(width, dtype=np.uint8) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    values = raw[starts].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        values[longer] |= raw[starts[longer] + k].astype("<u4") << np.uint32(8 * k)
    return values


def tokenized(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False
) -> DataFrame:
    """doc_id and the ids of each whole text with ``end_id``, as little-endian bytes of the encoder's width."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, added)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in small_batches(batches, most_bytes=BATCH):
            flat, counts = words.encode_all(batch.column(1).to_pylist())
            ids = [x.tobytes() + end for x in np.split(flat, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    schema = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {schema}, ids binary")


def frequencies(tokens: DataFrame, dtype: str) -> DataFrame:
    """id and its count over all documents; at most one row per vocabulary entry and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(n) > len(total):
                    n, total = total, n.astype(np.int64)
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are: ``rows`` (doc_id, n_tokens, control, data) and ``ranks`` (id, rank).

    ``rows`` has one folder per range of ``doc_id``, numbered in ascending order, with one sorted file each.
    """

    rows: str
    ranks: str
    schema: str


def write(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False
) -> TokenFiles:
    """Tokenize, rank and write; the texts are read and tokenized once. ``added``: as in ``WordEncoder``.

    The rank table has at most one row per vocabulary entry, which bounds what the driver collects and
    what each task gets.
    """
    spark = docs.sparkSession
    dtype = encoder(path).dtype
    raw = shared_folder(spark, "token-ids")
    tokenized(docs, path, end_id, id_col, text_col, added).write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.parquet(raw)
    counts = frequencies(tokens, dtype).toPandas().sort_values(["n", "id"], ascending=[False, True])
    by_rank = counts["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, control binary, data binary"
    out = TokenFiles(shared_folder(spark, "token-files"), shared_folder(spark, "token-ranks"), schema)
    ranks = spark.createDataFrame(
        counts.assign(rank=range(len(counts)))[["id", "rank"]], "id long, rank long"
    )
    ranks.coalesce(1).write.parquet(out.ranks)
    shared = spark.sparkContext.broadcast(rank_of)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            packed, sizes = [], []
            for ids in batch.column(1):
                values = np.frombuffer(ids.as_buffer(), dtype)
                packed.append(pack(ranks[values]))
                sizes.append(len(values))
            control, data = zip(*packed, strict=True) if packed else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(control, pa.binary()),
                    pa.array(data, pa.binary()),
                ],
                ["doc_id", "n_tokens", "control", "data"],
            )

    coded = tokens.mapInArrow(encode, schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = coded.withColumn("part", range_part(tokens, "doc_id", parts))
    order = ["part", "doc_id", "n_tokens", "control", "data"]
    coded.repartition(parts, "part").sortWithinPartitions(*order).write.partitionBy("part").parquet(out.rows)
    return out


def _decoded(spark: SparkSession, files: TokenFiles, name: str, kind: str, finish: Callable) -> DataFrame:
    """doc_id, n_tokens and a column made of each document's ids (little-endian unsigned 32-bit)."""
    by_rank = spark.read.parquet(files.ranks).toPandas().sort_values("rank")["id"].to_numpy("<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    rows = spark.read.schema(files.schema).parquet(files.rows).select("doc_id", "n_tokens", "control", "data")
    types = {"binary": pa.binary(), "long": pa.int64()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            cells = zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)
            found = [finish(ids[unpack(c.as_buffer(), d.as_buffer(), n)].tobytes()) for n, c, d in cells]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, types[kind])], ["doc_id", "n_tokens", name]
            )

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"doc_id {key}, n_tokens long, {name} {kind}")


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, n_tokens and the ids (little-endian unsigned 32-bit) of each document, from the files."""
    return _decoded(spark, files, "ids", "binary", lambda ids: ids)


def digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids; start counts the ids before it."""
    rows = settle(_decoded(spark, files, "ids_crc32", "long", zlib.crc32), "token-digests")
    placed = running_total(rows, ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")
