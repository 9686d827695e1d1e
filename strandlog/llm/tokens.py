"""Encoding with a public tokenizer, remembering the ids of chunks that it never merges across.

Both kinds of tokenizer below cut text between a character that is no white
space and one that is, before any merge, so the ids of a text are those of its
chunks end to end. Chunks are found, hashed, looked up in bulk and compared byte by
byte with what is remembered; the library sees each chunk once.

Defined cases: an empty text has no ids; a very long text is encoded some chunks at
a time, and what is remembered stays bounded however many different chunks it has; a
chunk whose hash belongs to another one is encoded anew each time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .common import lanes, word_hashes, words

#: White space outside ASCII in UTF-8 (two and three bytes), fixed by Unicode.
_WIDE_SPACE = np.array(
    [0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
)
_SPACE, _LETTER, _POINT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = _POINT
#: Chunks that are one piece before the merges: letters that no normaliser recomposes.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it has to be there on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies spell the 256 bytes: printable Latin-1 as itself, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class _Table:
    """A hash table of 64-bit keys with bulk look-up, by open addressing."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        key = self.keys[slot]
        out = np.where(key == h, self.at[slot], -1)
        more = np.flatnonzero((key != h) & (key != 0))
        while len(more):
            slot[more] = (slot[more] + np.uint64(1)) & self.mask
            key = self.keys[slot[more]]
            hit = key == h[more]
            out[more[hit]] = self.at[slot[more[hit]]]
            more = more[~hit & (key != 0)]
        return out

    def put(self, h: np.ndarray, at: np.ndarray) -> None:
        """h: different keys that are not in the table."""
        slot, left = h & self.mask, np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.at[slot[won]] = at[won]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class Encoder:
    """Memory is bounded: after `most` different chunks the ids learnt are forgotten.

    A text is worked on in pieces of `most // 4` chunks, so that a piece never fills the table.
    """

    def __init__(self, name: str, most: int = 400_000):
        self.tok = Tokenizer.from_file(vocabulary(name))
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.byte_level = name.startswith("byte")
        self.vocab_size = self.tok.get_vocab_size()
        self.letters = _byte_letters()
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.table, self.n = _Table(max(10, (2 * self.most).bit_length())), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros(1 << 14, np.int64)  # begin[i] .. begin[i + 1]: the ids of chunk i
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0
        self.raw_begin = np.zeros(1 << 14, np.int64)  # the same of its bytes

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, and the bounds of each text's."""
        kind = _KIND[data]
        mark = np.zeros(len(data) + 1, bool)
        # Letters end where punctuation follows, whatever the tokenizer.
        mark[1:-1] = (kind[1:] == _POINT) & (kind[:-1] == _LETTER)
        if not self.byte_level:
            start, end, _ = words(data, off)
            mark[off] = False
            inner = np.flatnonzero(mark)
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
            return start, end, np.searchsorted(start, off)
        space = kind == _SPACE
        cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        mark[cut] = True
        last = data[cut - 1]
        at = cut[(last >= 0x80) | ((last >= 0x1C) & (last <= 0x1F))]
        two = data[np.maximum(at - 2, 0)].astype(np.int64) << 8 | data[at - 1]
        three = data[np.maximum(at - 3, 0)].astype(np.int64) << 16 | two
        mark[at[np.isin(two, _WIDE_SPACE) | np.isin(three, _WIDE_SPACE) | (data[at - 1] < 0x80)]] = False
        mark[off] = True
        start = np.flatnonzero(mark[:-1])
        return start, np.append(start[1:], len(data)), np.searchsorted(start, off)

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        """What the library says of each chunk."""
        one, letters, found, rest, where = self.tok.model.tokenize, self.letters, [], [], []
        for raw in chunks:
            c = raw.decode("utf-8", "replace")
            if _PLAIN.fullmatch(c, self.byte_level and c[0] == " "):
                if not self.byte_level:
                    c = c.lower()
                found.append([t.id for t in one(c.encode().decode("latin-1").translate(letters))])
            else:
                where.append(len(found))
                found.append(rest.append(c))
        for i, e in zip(where, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def _learn(self, chunks: list[bytes]) -> None:
        """Append the ids and bytes of new chunks."""
        found = self._ids(chunks)
        size = np.fromiter(map(len, found), np.int64, len(found))
        long = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.ids = _room(self.ids, self.used, int(size.sum()))
        self.raw = _room(self.raw, self.raw_used, int(long.sum()) + 8)
        self.begin, self.raw_begin = (_room(x, self.n, len(found) + 1) for x in (self.begin, self.raw_begin))
        self.ids[self.used : self.used + int(size.sum())] = np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))
        self.raw[self.raw_used : self.raw_used + int(long.sum())] = np.frombuffer(b"".join(chunks), np.uint8)
        self.begin[self.n + 1 : self.n + 1 + len(found)] = self.used + np.cumsum(size)
        self.raw_begin[self.n + 1 : self.n + 1 + len(found)] = self.raw_used + np.cumsum(long)
        self.used, self.raw_used, self.n = self.used + int(size.sum()), self.raw_used + int(long.sum()), self.n + len(found)

    def _is(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each chunk of data has the bytes of the one that is remembered at `at`."""
        size = end - start
        same = size == self.raw_begin[at + 1] - self.raw_begin[at]
        mine, known = lanes(data), np.ndarray((len(self.raw) - 7,), "<u8", self.raw.data, strides=(1,))
        more, at_byte = np.flatnonzero(same), 0
        while len(more):
            if at_byte >= 64:
                for i in more.tolist():
                    own, first = data[start[i] : end[i]], self.raw_begin[at[i]]
                    same[i] = np.array_equal(own, self.raw[first : first + len(own)])
                break
            drop = np.uint64(8) * (np.uint64(8) - np.minimum(size[more] - at_byte, 8).astype(np.uint64))
            same[more] = (mine[start[more] + at_byte] ^ known[self.raw_begin[at[more]] + at_byte]) << drop == 0
            at_byte += 8
            more = more[same[more] & (size[more] > at_byte)]
        return same

    def _piece(self, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks end to end, and how many each has."""
        h = word_hashes(data, start, end) | np.uint64(1)
        if self.n > self.most:
            self._forget()
        at = self.table.find(h)
        if len(new := np.flatnonzero(at < 0)):
            keys, first = np.unique(h[new], return_index=True)
            first = new[first]
            self.table.put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
            self._learn([raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            at[new] = self.table.find(h[new])
        other = np.flatnonzero(~self._is(data, start, end, at))
        n = self.begin[at + 1] - self.begin[at]
        begin, ids = self.begin[at], self.ids
        if len(other):  # two chunks with one hash
            found = self._ids([raw[s:e] for s, e in zip(start[other].tolist(), end[other].tolist(), strict=True)])
            n[other] = [len(f) for f in found]
            begin[other] = self.used + np.cumsum(n[other]) - n[other]
            ids = np.concatenate([ids[: self.used], np.array([i for f in found for i in f], np.uint32)])
        stop = np.cumsum(n)
        return ids[np.repeat(begin - (stop - n), n) + np.arange(stop[-1])], n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts as UTF-8 bytes end to end with their n + 1 offsets: all ids end to end, and their n + 1 bounds."""
        start, end, upto = self._chunks(data, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        raw, step = data.tobytes(), max(64, self.most // 4)
        ids, n = zip(*(self._piece(data, raw, start[i : i + step], end[i : i + step]) for i in range(0, len(start), step)), strict=True)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(n))])[upto]


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """a with room for more values after the used ones, and as many again."""
    return a if used + more <= len(a) else np.concatenate([a, np.zeros(used + more, a.dtype)])


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    """One for each Python worker: what a task has learnt serves the next, and memory is taken once."""
    return Encoder(name)
