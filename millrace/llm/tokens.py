"""Token ids of whole texts, with each distinct piece of text encoded once per worker.

Texts are cut where the tokenizer's own pre-tokenisation always cuts: at white space and between
ASCII letters and ASCII punctuation; texts with the literal of a special token are not cut. Pieces are told apart by 64-bit hashes in numpy; the
tokenizers library encodes the pieces not met before. Results equal encoding the whole text.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words as W

#: Pieces a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
#: Longer pieces are encoded each time.
LONGEST = 64
#: White space beyond ASCII, and separators that libraries class differently: such texts are encoded whole.
UNUSUAL = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False  # an apostrophe can begin a contraction


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Encodes Arrow text columns.

    ``spaces``: the tokenizer keeps white space and joins one space to the word after it (byte-level BPE);
    otherwise it drops white space and lower-cases.
    """

    def __init__(self, path: str, spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces = Tokenizer.from_file(path), spaces
        # Texts with the literal of an added token are encoded whole, as the library looks for these first.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, begins and ends of the pieces, and the first piece of each text."""
        own, offsets = W.utf8(column)
        data = own if self.spaces else W.LOWER[own]
        word = W.NOT_SPACE[data]
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        before = np.concatenate([[False], word[:-1]]) & ~first
        start = first | (word != before)
        if self.spaces:
            at = np.flatnonzero(word & ~before & ~first)
            start[at] = data[at - 1] != 32
            start[at - 1] = True
        letter, mark = _LETTER[data], _MARK[data]
        start[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        whole = np.asarray(pc.fill_null(pc.match_substring_regex(column, UNUSUAL), False))
        for literal in self.added:
            whole = whole | np.asarray(pc.fill_null(pc.match_substring(column, literal, ignore_case=True), False))
        for i in np.flatnonzero(whole):
            start[offsets[i] : offsets[i + 1]] = False
            start[offsets[i]] = True
            if not self.spaces:
                data[offsets[i] : offsets[i + 1]] = own[offsets[i] : offsets[i + 1]]
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        if not self.spaces:
            keep = word[begin]
            if whole.any():
                keep |= whole[np.searchsorted(offsets, begin, "right") - 1]
            begin, end = begin[keep], end[keep]
        return data, begin, end, np.searchsorted(begin, offsets)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. A single word goes straight to the tokenizer's model, which is faster."""
        out: list = [None] * len(pieces)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for i, piece in enumerate(pieces):
            word = piece[1:] if self.spaces and piece[:1] == " " else piece
            if word.isalpha() and (self.spaces or piece.isascii() or (unicodedata.is_normalized("NFC", piece) and piece == piece.lower())):
                out[i] = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                rest.append(i)
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = found.ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin. A null text is an empty one."""
        data, begin, end, first = self._pieces(column)
        unique, example, which = np.unique(W.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any() and len(self.keys) + new.sum() > REMEMBERED:
            self._forget()
            new = np.ones(len(unique), bool)
        long = np.zeros(0, np.int64)
        if new.any():
            spot = example[new]
            found = self._encode([data[a:b].tobytes().decode() for a, b in zip(begin[spot], end[spot])])
            size = np.array([len(x) for x in found], np.int64)
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            starts = len(self.ids) + np.cumsum(size) - size
            self.keys = keys[order]
            self.begin, self.size = np.concatenate([self.begin, starts])[order], np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
            long = unique[new][(end - begin)[spot] > LONGEST]
        at = np.searchsorted(self.keys, unique)
        size, source = self.size[at][which], self.begin[at][which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(source - (ends - size), size)] if total else np.zeros(0, np.uint32)
        if len(long):
            keep = ~np.isin(self.keys, long)
            self.keys, self.begin, self.size = self.keys[keep], self.begin[keep], self.size[keep]
        return ids, np.concatenate([[0], ends])[first]


@functools.lru_cache(2)
def encoder(path: str, spaces: bool) -> Encoder:
    """The encoder of this Python worker, which outlives a task."""
    return Encoder(path, spaces)


def width(path: str) -> str:
    """Smallest little-endian type of the tokenizer's ids."""
    return "<u2" if encoder(path, True).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
