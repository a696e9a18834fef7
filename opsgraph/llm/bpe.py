"""A byte-level byte-pair tokenizer compiled to a deterministic transducer.

A text is cut before every ASCII white space that follows a character which is surely no white space, and where letters,
digits and signs meet; the tokenizer's pre-splitting never joins across such a place, so a text's tokens are its segments'
tokens one after another. The transducer reads bytes. Its states are the prefixes of segments, told apart by their path hash and its check, 128 bits
together; the transition that ends a segment leads back to the start and is annotated with the token ids it emits, and
their number. States are determinised as texts reach them, each by one call of the tokenizers library on the segment, and
thrown away when MAX_STATES ends are annotated. Segments of over EXACT bytes are known by their bytes instead.

All segments of a batch take their transitions at once: path hashes are differences of running sums.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from opsgraph.llm.common import hashed_runs, offsets, raw

MAX_STATES = 1 << 20
EXACT = 64
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def after_space(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is, or may count as, white space."""
    last = data[place - 1]
    two, three = data[np.maximum(place - 2, 0)], data[np.maximum(place - 3, 0)]
    # Unicode's white space beyond ASCII in UTF-8, and the ASCII separators on which libraries differ.
    found = (last >= 0x1C) & (last <= 0x1F)
    found |= (two == 0xC2) & ((last == 0x85) | (last == 0xA0))
    found |= (three == 0xE1) & (((two == 0x9A) & (last == 0x80)) | ((two == 0xA0) & (last == 0x8E)))
    found |= (three == 0xE2) & (two == 0x80) & ((last <= 0x8A) & (last >= 0x80) | np.isin(last, [0xA8, 0xA9, 0xAF]))
    found |= (three == 0xE2) & (two == 0x81) & (last == 0x9F)
    found |= (three == 0xE3) & (two == 0x80) & (last == 0x80)
    return found


def sure_ends(kind: str | None, special: list[bytes]) -> np.ndarray:
    """[last byte, next byte]: whether a segment surely ends between the two, for byte-level pre-splitting or any other (None).

    Before white space always, if `after_space` agrees. Byte-level splitting also ends runs of letters, digits and other
    signs where one meets another in ASCII, but for an apostrophe before a letter. Never where two bytes stand in a
    special token, which is one piece.
    """
    char = np.arange(256)
    out = np.zeros((256, 256), bool)
    out[np.ix_(~SPACE, SPACE)] = True
    if kind == "ByteLevel":
        letter = ((char | 32) >= 97) & ((char | 32) <= 122) & (char < 128)
        digit = (char >= 48) & (char <= 57)
        sign = (char > 32) & (char < 127) & ~letter & ~digit
        for x in (letter, digit, sign):
            for y in (letter, digit, sign):
                if x is not y:
                    out[np.ix_(x, y)] = True
        out[ord("'")] = SPACE
    for token in special:
        for x, y in zip(token, token[1:], strict=False):
            out[x, y] = False
    return out


def segment_starts(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the segments of the texts data[at[i]:at[i + 1]] begin."""
    mark = np.zeros(len(data) + 1, bool)
    if len(data):
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        mark[1:-1] = ends.ravel()[pair]
        # What may be white space beyond ASCII is decided on the places after such bytes only.
        odd = np.flatnonzero(mark[1:-1] & ((data[:-1] >= 0x80) | (data[:-1] < 0x20))) + 1
        mark[odd[after_space(data, odd)]] = False
    mark[at] = True
    return np.flatnonzero(mark[: len(data)])


class Transducer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        level = split.get("type") if split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer") else None
        self.ends = sure_ends(level, [t["content"].encode() for t in made.get("added_tokens", [])])
        self._clear()

    def _clear(self) -> None:
        self.n = 0
        self.key, self.check = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.uint64)
        self.begin = np.zeros((1 << 10) + 1, np.int64)  # of each end's token ids
        self.ids = np.zeros(1 << 12, np.uint32)
        self.slots = np.full(1 << 12, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def _reached(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each segment's end state; -1: not there yet."""
        mask = len(self.slots) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            e = self.slots[slot[left]]
            hit = (e >= 0) & (self.key[e] == key[left]) & (self.check[e] == check[left])
            out[left[hit]] = e[hit]
            left = left[(e >= 0) & ~hit]
            slot[left] = (slot[left] + 1) & mask
        return out

    def _annotate(self, segments: list[bytes]) -> np.ndarray:
        """New ends with the token ids that they emit."""
        coded = self.tokenizer.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)
        ids = [c.ids for c in coded]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, stop = int(self.begin[self.n]), self.n + len(segments)
        while len(self.key) < stop:
            self.key, self.check = np.concatenate([self.key, np.zeros_like(self.key)]), np.concatenate([self.check, np.zeros_like(self.check)])
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin) - 1, np.int64)])
        while len(self.ids) < first + sizes.sum():
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first : first + int(sizes.sum())] = np.fromiter((i for c in ids for i in c), np.uint32, int(sizes.sum()))
        self.begin[self.n + 1 : stop + 1] = first + np.cumsum(sizes)
        new = np.arange(self.n, stop)
        self.n = stop
        return new

    def _place(self, states: np.ndarray) -> None:
        """States into the slots, which are twice as many at least."""
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
            states = np.arange(self.n)
            states = states[(self.key[states] != 0) | (self.check[states] != 0)]  # those known by their bytes have no slot
        mask = len(self.slots) - 1
        for e, slot in zip(states.tolist(), (self.key[states] & np.uint64(mask)).tolist(), strict=True):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = e

    def run(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The end state of every segment of the texts, and where each text's segments begin (one more entry)."""
        if self.n > MAX_STATES:
            self._clear()
        data, at = raw(text), offsets(text)
        starts = segment_starts(data, at, self.ends)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        state = np.full(len(starts), -1, np.int32)
        buffer = data.tobytes() if len(data) else b""
        size = ends - starts
        long = np.flatnonzero(size > EXACT)
        for i in long.tolist():
            segment = buffer[starts[i] : ends[i]]
            if segment not in self.long:
                self.long[segment] = int(self._annotate([segment])[0])
            state[i] = self.long[segment]
        short = np.flatnonzero(size <= EXACT)
        with np.errstate(over="ignore"):
            key, check = (hashed_runs(data, starts[short], ends[short], seed) for seed in (1, 2))
        while len(short):
            state[short] = self._reached(key, check)
            unknown = state[short] < 0
            short, key, check = short[unknown], key[unknown], check[unknown]
            if len(short):
                fresh = np.unique(key, return_index=True)[1]
                new = self._annotate([buffer[starts[i] : ends[i]] for i in short[fresh].tolist()])
                self.key[new], self.check[new] = key[fresh], check[fresh]
                self._place(new)
        return state, np.searchsorted(starts, at)

    def counts(self, text: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        state, first = self.run(text)
        total = np.concatenate([[0], np.cumsum(self.begin[state + 1] - self.begin[state])])
        return total[first[1:]] - total[first[:-1]]

    def coded(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts, one after another, and where each text's begin (one more entry)."""
        state, first = self.run(text)
        begin = self.begin[state]
        size = self.begin[state + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.ids[place], total[first]


@lru_cache(4)
def transducer(path: str) -> Transducer:
    """One for each worker process and tokenizer."""
    return Transducer(path)
