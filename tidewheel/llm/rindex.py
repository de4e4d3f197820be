"""A run-length index of short texts, and matching statistics streamed over it.

``RunIndex`` holds the runs of the Burrows-Wheeler transform of its texts: for each run its symbol,
first row and length, the row that the last-to-first mapping gives its first row, and the text
positions of its first and last row (the sampled run ends). Memory beside the texts' own bytes
follows the number of runs. Texts may be kept apart in blocks: a symbol is a byte of a block, so texts
of different blocks never match.

``matching_lengths`` streams texts backwards over the index, all in step. The state is a row and the
position of its suffix. While the row's symbol is the byte that comes next, the mapping gives the
row and the position goes down by one. Otherwise the nearest run ends with that symbol above and
below are tried: their samples are positions, so both candidates are compared with the text, and the
longer match goes on. Lengths are exact up to ``most``.

``seen_before`` marks the windows that start earlier elsewhere. Texts have an order within their
group; at each level the texts of every block of 2^level are streamed over an index of the block
before them, so each text meets all earlier ones of its group in as many levels as the group's size
has bits, and never itself.
"""

from __future__ import annotations

import numpy as np

#: Ends of indexed and of streamed texts; neither is a byte of UTF-8, so no match goes across them.
END, OTHER_END = 255, 254


def _joined(texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with an end after each text and room to read words beyond; sizes; starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    mark = bytes([end])
    return np.frombuffer(mark.join([*texts, b""]) + bytes(16), np.uint8), sizes, np.cumsum(sizes + 1) - (sizes + 1)


def _words(text: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes at each place."""
    return np.ndarray((len(text) - 7,), kind, text.data, strides=(1,))


def _ranked(keys: np.ndarray) -> np.ndarray:
    by = np.argsort(keys)
    own = keys[by]
    rank = np.empty(len(keys), np.int64)
    rank[by] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
    return rank


def suffix_order(text: np.ndarray, sizes: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Places of all suffixes, by block and then by bytes up to and with their text's end; equal ones in the order of places. Sorted by 8 bytes first, then by three times as many, until no two are alike or texts are over."""
    n = int((sizes + 1).sum())
    left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(n)
    cut = (8 * np.maximum(7 - left, 0)).astype(np.uint64)
    rank = _ranked(_words(text, ">u8")[:n].astype(np.uint64) >> cut << cut)
    width, longest, places = 8, int(sizes.max()) + 1, np.arange(n)
    while width < longest and rank.max() < n - 1:
        many = int(rank.max()) + 2
        after = lambda w, rank=rank: np.where(left >= w, rank[np.minimum(places + w, n - 1)] + 1, 0)
        keys, times = rank * many + after(width), 2
        if many**3 < 1 << 63:
            keys, times = keys * many + after(2 * width), 3
        rank, width = _ranked(keys), width * times
    if len(block) and block.max() > block.min():
        rank = np.repeat(block, sizes + 1) * (int(rank.max()) + 1) + rank
    if (int(rank.max()) + 1) * n < 1 << 63:
        return np.argsort(rank * n + places)
    return np.argsort(rank, kind="stable")


class RunIndex:
    def __init__(self, texts: list[bytes], block: np.ndarray):
        self.text, sizes, starts = _joined(texts, END)
        self.n = n = int((sizes + 1).sum())
        order = suffix_order(self.text, sizes, block)
        before = np.concatenate([[END], self.text[: n - 1]]).astype(np.int64) + 256 * np.repeat(block, sizes + 1)
        symbols = before[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        lengths = np.diff(np.concatenate([first, [n]]))
        heads = symbols[first]
        # runs by symbol and row: a row's place among a symbol's runs is one search, and what comes before in this order are the rows that the mapping gives
        by = np.lexsort((first, heads))
        self.runs = len(first)
        self.head, self.first, self.length = heads[by], first[by], lengths[by]
        self.key = self.head * (n + 1) + self.first
        self.maps_to = np.cumsum(self.length) - self.length
        self.first_at, self.last_at = order[first][by], order[first + lengths - 1][by]
        self.start = int(order[0])

    def matching_lengths(self, texts: list[bytes], block: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the texts, one text after the other: the length of the longest match that begins there, up to most, and where in the index's text it lies (-1: nowhere)."""
        own, sizes, starts = _joined(texts, OTHER_END)
        here, there = _words(self.text, "<u8"), _words(own, "<u8")
        out = np.zeros(int(sizes.sum()), np.int32)
        where = np.full(len(out), -1, np.int64)
        to = np.cumsum(sizes) - sizes
        by = np.argsort(-sizes, kind="stable")
        ordered, base, slot, high = sizes[by], starts[by], to[by], block[by] * 256
        row, place, length = np.zeros(len(by), np.int64), np.full(len(by), self.start, np.int64), np.zeros(len(by), np.int64)
        for step in range(1, int(ordered[0]) + 1 if len(by) else 0):
            live = int(np.searchsorted(-ordered, -step, "right"))
            at = base[:live] + ordered[:live] - step
            symbol = high[:live] + own[at]
            k = np.searchsorted(self.key, symbol * (self.n + 1) + row[:live], "right") - 1
            low = np.maximum(k, 0)
            same = (k >= 0) & (self.head[low] == symbol)
            off = row[:live] - self.first[low]
            goes_on = same & (off < self.length[low])
            jumps = np.flatnonzero(~goes_on)
            row[:live] = self.maps_to[low] + off
            place[:live] -= 1
            length[:live] += 1
            if len(jumps):
                up, down = k[jumps], np.minimum(k[jumps] + 1, self.runs - 1)
                has_up, has_down = same[jumps], (k[jumps] + 1 < self.runs) & (self.head[down] == symbol[jumps])
                bound = length[jumps] - 1
                after = at[jumps] + 1
                up = np.maximum(up, 0)
                long_up = np.where(has_up, _common(here, self.last_at[up], there, after, np.where(has_up, bound, 0)), -1)
                long_down = np.where(has_down, _common(here, self.first_at[down], there, after, np.where(has_down, bound, 0)), -1)
                higher = long_up >= long_down
                found = np.maximum(long_up, long_down)
                row[jumps] = np.where(higher, self.maps_to[up] + self.length[up] - 1, self.maps_to[down])
                place[jumps] = np.where(higher, self.last_at[up], self.first_at[down]) - 1
                length[jumps] = found + 1
                nowhere = jumps[found < 0]
                row[nowhere], place[nowhere] = 0, self.start
            np.minimum(length, most, out=length)
            to_here = slot[:live] + ordered[:live] - step
            out[to_here] = length[:live]
            where[to_here] = np.where(length[:live] > 0, place[:live], -1)
        return out, where


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many bytes from i and from j are the same, up to bound; a and b: the 8 bytes at each place."""
    out = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(bound > 0)
    done = 0
    while len(open_):
        x = a[np.minimum(i[open_] + done, len(a) - 1)] ^ b[np.minimum(j[open_] + done, len(b) - 1)]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        out[open_] = done + same
        done += 8
        open_ = open_[(same == 8) & (bound[open_] > done)]
    return np.minimum(out, bound)


def seen_before(texts: list[bytes], groups: np.ndarray, order: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of length bytes that start earlier in another text of their group: text number, first window's start, windows.

    order: keys of the texts' order, the most important first. Texts have distinct keys in a group.
    """
    none = np.empty(0, np.int64)
    if len(texts) < 2:
        return none, none, none
    by = np.lexsort((*order[::-1], groups))
    fresh = np.concatenate([[True], groups[by][1:] != groups[by][:-1]])
    first = np.flatnonzero(fresh)
    members = np.diff(np.concatenate([first, [len(by)]]))
    group, rank, of_group = (np.empty(len(by), np.int64) for _ in range(3))
    group[by] = np.repeat(np.arange(len(first)), members)
    rank[by] = np.arange(len(by)) - np.repeat(first, members)
    of_group[by] = np.repeat(members, members)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = np.maximum(sizes - length + 1, 0)
    base = np.cumsum(windows) - windows
    late = np.zeros(int(windows.sum()), bool)
    open_ = windows > 0
    for level in range(int(of_group.max() - 1).bit_length()):
        side, part = rank >> level & 1, rank >> (level + 1)
        block = _ranked(group * (len(texts) + 1) + part)
        streamed = np.flatnonzero((side == 1) & open_)
        kept = np.flatnonzero((side == 0) & (windows > 0) & ((part << (level + 1)) + (1 << level) < of_group))
        if not len(streamed) or not len(kept):
            continue
        index = RunIndex([texts[k] for k in kept.tolist()], block[kept])
        lengths, _ = index.matching_lengths([texts[k] for k in streamed.tolist()], block[streamed], length)
        w = windows[streamed]
        within = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        from_ = np.repeat(np.cumsum(sizes[streamed]) - sizes[streamed], w) + within
        late[np.repeat(base[streamed], w) + within] |= lengths[from_] >= length
        missing = np.concatenate([[0], np.cumsum(~late)])
        open_[streamed] = missing[base[streamed] + w] > missing[base[streamed]]
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.flatnonzero(late)
    if not len(at):
        return none, none, none
    number, start = text[at], at - base[text[at]]
    cut = np.concatenate([[0], np.flatnonzero((number[1:] != number[:-1]) | (start[1:] != start[:-1] + 1)) + 1])
    return number[cut], start[cut], np.diff(np.concatenate([cut, [len(number)]]))
