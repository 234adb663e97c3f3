"""Byte-level BPE by a sentencepiece model that is serialised from a rank file, and decoding by the inverse mapping.

Each byte is written as one character, so a token of the rank file is a string. These strings, scored by negative
rank and with identity normalisation, are the pieces of a sentencepiece BPE model: its merges (best score first,
then leftmost) are then those of the ranks. Texts are cut at a pattern, every match is encoded on its own, and a
match that is itself a token is that token. A bounded table per worker holds the ids of short matches met before.

The pattern's classes of letters, numbers and white space are those of the tiktoken library: characters that the
``regex`` package puts in another class, being of another Unicode version, are found by asking tiktoken, and a
character of the right class stands in for them while the text is cut.

Defined cases: null and empty texts have no ids and decode to no bytes; texts and matches of any length are encoded
whole; equal rows have equal ids; an empty table gives no rows; other columns are not read; special tokens are
ordinary text; ids that are null or not in the vocabulary are an error in decoding, a null list decodes to null.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from holdfast.llm.common import small_batches, tokenizer_path

MOST_WORDS = 400_000
LONGEST_KEPT = 64

#: Byte ``b`` as the character ``256 + b``: none of these is white space or a mark of sentencepiece's own.
_TO_PIECE = {b: chr(256 + b) for b in range(256)}


def split_pattern() -> str:
    """The pattern that cuts texts before the merges of the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return tokenizer_path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank, from lines of a base64 text and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def piece_of(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_PIECE)


def bytes_of(piece: str) -> bytes:
    """The inverse of ``piece_of``."""
    return bytes(ord(c) - 256 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def model_proto(tokens: Iterable[bytes]) -> bytes:
    """A sentencepiece model, as its protocol buffer's bytes: tokens in the order of their ranks."""
    # Numbers of the fields and kinds in sentencepiece's model format.
    normal, unknown, bpe = 1, 2, 2
    pieces = [piece_of(t) for t in tokens]
    body = b"".join(_piece(p, -float(k), normal) for k, p in enumerate(pieces))
    body += _piece("<unk>", 0.0, unknown)
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, len(pieces))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _block(2, trainer) + _block(3, identity)


@lru_cache(maxsize=1)
def _odd_characters() -> dict[str, str]:
    """Characters whose class differs between ``regex`` and tiktoken, and one that is in tiktoken's class for each."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    classes: dict[str, set[str]] = {}
    for stand_in, kind in (("a", r"\p{L}"), ("0", r"\p{N}"), ("\t", r"\s")):
        asked = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(asked.encode_ordinary(every)).decode())
        for c in theirs ^ set(regex.findall(kind, every)):
            classes.setdefault(c, set())
            if c in theirs:
                classes[c].add(stand_in)
    return {c: min(found, default="!") for c, found in classes.items()}


class Splitter:
    """Matches of a pattern, as the tiktoken library finds them."""

    def __init__(self, pattern: str, odd: dict[str, str]):
        self._find = regex.compile(pattern)
        self._table = {ord(c): stand_in for c, stand_in in odd.items()}
        self._odd = frozenset(odd)

    def split(self, text: str) -> list[str]:
        if text.isascii() or self._odd.isdisjoint(text):
            return self._find.findall(text)
        return [text[m.start() : m.end()] for m in self._find.finditer(text.translate(self._table))]


class ByteBpe:
    """Ids of texts, equal to the tiktoken library's, and bytes of ids."""

    def __init__(self, path: str, pattern: str, odd: dict[str, str], most_words: int = MOST_WORDS):
        import sentencepiece

        self.ranks = read_ranks(path)
        tokens = sorted(self.ranks, key=self.ranks.get)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self._ids = np.array([self.ranks[t] for t in tokens], np.int32)
        self._splitter = Splitter(pattern, odd)
        self._most = most_words
        self._known: dict[str, bytes] = {}
        own = [bytes_of(self._sp.id_to_piece(k)) for k in range(len(tokens))]
        size = np.zeros(int(self._ids.max()) + 1, np.int64)
        size[self._ids] = [len(b) for b in own]
        start = np.full(len(size), -1, np.int64)
        start[self._ids] = np.cumsum(size[self._ids]) - size[self._ids]
        self._size, self._start, self._flat = size, start, np.frombuffer(b"".join(own), np.uint8)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        found: list[bytes] = [b""] * len(words)
        rest = []
        for k, word in enumerate(words):
            rank = self.ranks.get(word.encode())
            if rank is None:
                rest.append(k)
            else:
                found[k] = struct.pack("<i", rank)
        pieces = [piece_of(words[k].encode()) for k in rest]
        own = self._sp.encode(pieces, out_type=int, num_threads=1) if pieces else []
        flat = self._ids[np.fromiter(chain.from_iterable(own), np.int64)].astype("<i4").tobytes()
        ends = np.cumsum([0, *map(len, own)]) * 4
        for k, a, b in zip(rest, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            found[k] = flat[a:b]
        return found

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        lists = [self._splitter.split(t) if t else [] for t in texts]
        if len(self._known) > self._most:
            self._known.clear()
        known = self._known
        new = list(set().union(*lists).difference(known))
        if new:
            known.update(zip(new, self._encode_words(new), strict=True))
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in lists]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del known[word]
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, number of bytes of each id)."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._size) or (self._start[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self._size[ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self._flat[np.repeat(self._start[ids] - (upto - size), size) + np.arange(total)], size


@lru_cache(maxsize=1)
def _worker_model(path: str, pattern: str, odd: tuple[tuple[str, str], ...]) -> ByteBpe:
    return ByteBpe(path, pattern, dict(odd))


def byte_bpe(path: str, pattern: str | None = None, most_words: int = MOST_WORDS) -> ByteBpe:
    """The encoder of a rank file; on a cluster the path must be there on all machines."""
    return ByteBpe(path, pattern or split_pattern(), _odd_characters(), most_words)


def encoded(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (list of int) of every whole text; a projection without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    how = pattern or split_pattern()
    odd = tuple(sorted(_odd_characters().items()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker_model(path, how, odd)
        for batch in small_batches(batches, most_bytes=4 << 20):
            found = model.encode_all(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes that their ids stand for."""
    at = rows.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker_model(path, "", ())
        for batch in batches:
            ids = batch.column(at)
            flat = ids.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            data, size = model.decode(flat.to_numpy())
            counts = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy()
            upto = np.concatenate([[0], np.cumsum(size)])
            cuts = upto[np.concatenate([[0], np.cumsum(counts)])]
            raw = data.tobytes()
            valid = ids.is_valid().to_pylist()
            own = [raw[a:b] if v else None for a, b, v in zip(cuts[:-1], cuts[1:], valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], [*batch.schema.names, "decoded"])

    if "decoded" in rows.columns:
        raise ValueError("the rows have a column decoded already")
    return rows.mapInArrow(decode, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def digests(decoded_rows: DataFrame) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the bytes."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded_rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
