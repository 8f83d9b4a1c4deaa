"""Fast exact encoding with a byte-level BPE of the tokenizers library.

Such a tokenizer first splits a text from left to right, without looking back.
No piece of that split goes on past the end of a run of letters into ASCII
punctuation, or past a character that is no white space into a blank. A text
can thus be cut at these places without changing its ids. The cuts are found on
the UTF-8 buffer, each distinct chunk is encoded by the library, many in one
call, and ids are put together from a cache.

The cache is direct-mapped with a fixed number of slots, so its memory is
bounded; a chunk that lost its slot is encoded again.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from .textkernel import U64, span_hash

SLOT_BITS = 21
#: Ids that the cache holds at most before it starts anew.
MOST_IDS = 1 << 24
#: Chunks that the library gets as one text.
TOGETHER = 500
_CUT = np.zeros(256, bool)
_CUT[[9, 10, 13, 32]] = True
_SURE = np.zeros(256, bool)
_SURE[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _SURE & ~_LETTER
_MARK[48:58] = False


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of chunks that may be encoded on their own; empty texts have none."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cut = np.zeros(len(buf), bool)
    # before a blank after an ASCII character that is no blank, or after a two-byte character of U+00C0 to U+024F
    cut[1:] = _SURE[buf[:-1]]
    cut[2:] |= (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xC9) & (buf[1:-1] >= 0x80)
    cut &= _CUT[buf]
    cut[1:] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    cut[offs[:-1][offs[:-1] < offs[-1]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs, "left")


_PLAIN = re.compile(rb"[\t\n\r ]?(?:[!-~]|[\xc3-\xc9][\x80-\xbf])")
_PLAIN_END = re.compile(rb"(?:[!-~]|[\xc3-\xc9][\x80-\xbf])\Z")


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int32)  # bytes of each id: a character of such a vocabulary stands for a byte
        for token, i in vocab.items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << SLOT_BITS, U64)
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.n = np.zeros(1 << SLOT_BITS, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the cache the ids of the chunks begin, and how many each has.

        Plain chunks go to the library many at once, with a line end between
        them, which stays a piece of its own there; the others go alone.
        """
        plain = np.array([_PLAIN.match(c) is not None and _PLAIN_END.search(c, max(len(c) - 2, 0)) is not None for c in chunks])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        chunks, n_plain = [chunks[i] for i in order], int(plain.sum())
        texts = [b"\n".join(chunks[i : min(i + TOGETHER, n_plain)]) for i in range(0, n_plain, TOGETHER)] + chunks[n_plain:]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)])
        size = np.array([len(c) for c in chunks])
        between = (np.arange(len(chunks)) % TOGETHER != TOGETHER - 1) & (np.arange(len(chunks)) < n_plain - 1)
        begin = np.concatenate([[0], np.cumsum(size + between)[:-1]])
        byte = np.concatenate([[0], np.cumsum(self.width[ids], dtype=np.int64)])
        at, to = np.searchsorted(byte, begin), np.searchsorted(byte, begin + size)
        if not (byte[at] == begin).all() or not (byte[to] == begin + size).all():
            raise AssertionError("the vocabulary's split is not the one this kernel is made for")
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(end, 2 * len(self.flat)) - len(self.flat), np.int32)])
        self.flat[self.used : end] = ids
        out = np.empty(len(chunks), np.int32), np.empty(len(chunks), np.int32)
        out[0][order], out[1][order] = at + self.used, to - at
        self.used = end
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begin): the ids of all texts, and where each text's begin (one entry more)."""
        starts, ends, first = chunk_bounds(buf, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        if self.used > MOST_IDS:
            self._clear()
        h = span_hash(buf, starts, ends, lower=False) | U64(1)
        slot = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        hit = self.key[slot] == h
        at, n = self.at[slot], self.n[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[where]
            raw = buf.tobytes()
            got_at, got_n = self._learn([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            at[miss], n[miss] = got_at[back], got_n[back]
            s = slot[where]
            self.key[s], self.at[s], self.n[s] = new, got_at, got_n
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        pos = np.arange(total[-1], dtype=np.int64) + np.repeat(at - total[:-1], n)
        return self.flat[pos], total[first]


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)
