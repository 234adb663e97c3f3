"""Token ids of whole texts by a public tokenizer, with the ids of words met before taken from a table.

Neither vocabulary family used here merges across the border between a non-space and a space, or between a
letter and a punctuation mark after it, so the ids of a text are those of its words in a row. Numpy finds and
hashes the words of a batch; the tokenizer encodes each new word once per worker process, and a sorted table of
64-bit word hashes gives the ids of the rest. The table keeps each word's bytes, and every word that it answers for is
compared with them; a batch with words that only share a hash is encoded without it. A full table is begun anew,
which bounds its memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

MOST_WORDS = 1_200_000
#: Bytes of words in the table after which it is begun anew.
MOST_BYTES = 48 << 20
#: Bytes of text that are encoded at once.
BATCH = 2 << 20

U = np.uint64
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: UTF-8 forms of the white space outside ASCII; fixed values.
_WIDE_SPACE = [
    c.encode()
    for c in "\x85\xa0                　"]


def _byte_marks() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints and as a character from 256 on elsewhere."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}


_MARKS = _byte_marks()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordEncoder:
    """Ids equal to the tokenizer's ``encode(text, add_special_tokens=False).ids``.

    With ``added`` a text is cut at the strings of the file's added tokens, each of which is one id, as in the
    library; without it these are ordinary text (``encode_special_tokens``). Byte-level vocabularies without a
    normalizer keep white space, which goes with the word after it; the others drop it.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS, added: bool = False):
        tokenizer = Tokenizer.from_file(path)
        tokens = tokenizer.get_added_tokens_decoder() if added else {}
        self._added = {t.content: i for i, t in tokens.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        # tokens that take in white space or are looked for in normal form are left to the library
        odd = any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokens.values())
        self._library = Tokenizer.from_file(path) if odd else None
        tokenizer.encode_special_tokens = True
        self.dtype = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._normal, self._pieces, self._model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self._spaces = self._normal is None
        self._most = most_words
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, U)
        self._first = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int32)
        self._pool = np.zeros(1 << 16, self.dtype)
        self._used = 0
        self._begin = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)
        self._bytes = np.zeros(1 << 18, np.uint8)
        self._filled = 0

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text; none for null or empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null counts as empty."""
        if self._library is not None:
            found = [e.ids for e in self._library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), self.dtype, int(counts.sum())), counts
        if not any(token in t for t in texts if t for token in self._added):
            return self._encode_plain(texts)
        segments: list[str] = []
        ends: list[int] = []  # id of the token after each segment; -1 after the last of a text
        firsts: list[int] = []
        for t in texts:
            parts = self._cut.split(t or "")
            firsts.append(len(segments))
            segments += parts[::2]
            ends += [*[self._added[x] for x in parts[1::2]], -1]
        ids, counts = self._encode_plain(segments)
        marked = np.flatnonzero(np.array(ends) >= 0)
        ids = np.insert(ids, np.cumsum(counts)[marked], np.array(ends)[marked].astype(self.dtype))
        counts[marked] += 1
        return ids, np.add.reduceat(counts, firsts)

    def _encode_plain(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_all`` of texts without added tokens."""
        raw = [(t or "").encode() for t in texts]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        text_starts = np.cumsum([0, *map(len, raw)])
        starts, ends = self._words(data, joined, text_starts)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(raw), np.int64)
        entry = self._entries(data, joined, starts, ends)
        bounds = np.searchsorted(starts, text_starts)
        if entry is None:
            found = [self._word(joined[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            upto = np.cumsum([0, *map(len, found)])
            return np.fromiter((i for ids in found for i in ids), self.dtype, int(upto[-1])), np.diff(upto[bounds])
        count = self._count[entry].astype(np.int64)
        upto = np.cumsum(count)
        ids = self._pool[np.repeat(self._first[entry] - (upto - count), count) + np.arange(upto[-1])]
        return ids, np.diff(np.concatenate([[0], upto])[bounds])

    def _words(self, data: np.ndarray, joined: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end, in bytes."""
        space = _SPACE[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
        if self._spaces:
            turn = space[1:] & ~space[:-1]
            for wide in _WIDE_SPACE:  # a run of mixed white space stays whole
                at = joined.find(wide)
                while at >= 0:
                    if at + len(wide) < len(data):
                        turn[at + len(wide) - 1] = False
                    at = joined.find(wide, at + 1)
            begin[1:-1] |= turn
            begin[text_starts] = True
            starts = np.flatnonzero(begin[:-1])
            return starts, np.append(starts[1:], len(data))
        begin[1:-1] |= space[:-1]
        begin[text_starts] = True
        begin[:-1] &= ~space
        starts = np.flatnonzero(begin[:-1])
        # a word ends where the next begins or at the first space before that
        stop = begin.copy()
        stop[:-1] |= space
        stop[-1] = True
        stops = np.flatnonzero(stop)
        return starts, stops[np.searchsorted(stops, starts, side="right")]

    def _entries(self, data: np.ndarray, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Rows of the table for all words, after encoding the new ones; none if a row's word is not the one asked for."""
        length = ends - starts
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        written = data if self._spaces else _FOLD[data[np.repeat(starts - first, length) + np.arange(len(place))]]
        codes = _BYTE[written]
        powers = np.cumprod(np.full(int(length.max()) + 1, _STEP))
        hashes = _mix(np.add.reduceat(codes * powers[place], first) + length.astype(U))
        keys, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._keys) + len(keys) > max(self._most, len(keys)) or self._filled > MOST_BYTES:
            self._clear()
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            words = sample[new]
            begin, end = starts[words].tolist(), ends[words].tolist()
            found = [self._word(joined[a:b].decode()) for a, b in zip(begin, end, strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), self.dtype, int(counts.sum()))
            while self._used + len(flat) > len(self._pool):
                self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
            self._pool[self._used : self._used + len(flat)] = flat
            spots = self._used + np.cumsum(counts) - counts
            self._used += len(flat)
            sizes = length[words]
            total = int(sizes.sum())
            while self._filled + total > len(self._bytes):
                self._bytes = np.concatenate([self._bytes, np.zeros_like(self._bytes)])
            places = np.cumsum(sizes) - sizes
            own = np.repeat(first[words] - places, sizes) + np.arange(total)
            self._bytes[self._filled : self._filled + total] = written[own]
            self._begin = np.insert(self._begin, at[new], self._filled + places)
            self._length = np.insert(self._length, at[new], sizes)
            self._filled += total
            self._keys = np.insert(self._keys, at[new], keys[new])
            self._first = np.insert(self._first, at[new], spots)
            self._count = np.insert(self._count, at[new], counts)
            at = np.searchsorted(self._keys, keys)
        entry = at[inverse]
        if (self._length[entry] != length).any():
            return None
        same = self._bytes[np.repeat(self._begin[entry] - first, length) + np.arange(len(place))] == written
        return entry if same.all() else None

    def _word(self, word: str) -> list[int]:
        """Ids of one word by the tokenizer's own parts."""
        body = word[1:] if self._spaces and word[0] == " " else word
        # a word of letters below U+0250 is one piece, and in normal form but for its case
        if body.isalpha() and max(body) < "ɐ" and "İ" not in body:
            text = word if self._spaces else word.lower()
            piece = text.encode().decode("latin-1").translate(_MARKS)
            return [t.id for t in self._model.tokenize(piece)]
        text = word if self._spaces else self._normal.normalize_str(word)
        return [t.id for piece, _ in self._pieces.pre_tokenize_str(text) for t in self._model.tokenize(piece)]


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path, added=added)
