"""Anchors: places in texts that equal passages have in common.

Of the ``gram``-byte strings of a window of ``length`` bytes, the one with the smallest hash (the
leftmost of equals) is the window's anchor. It depends on the window's bytes alone, so equal windows
have equal anchors at equal offsets. Windows that follow one another and share an anchor form a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 24
#: Bytes of text that are worked on at once; places within them fit 24 bits.
AT_ONCE = 2_000_000
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(words: np.ndarray) -> np.ndarray:
    h = words * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: bytes, n: int) -> np.ndarray:
    """A 64-bit hash of the 24 bytes at each of n places; data has at least 40 more bytes."""
    words = np.empty(n + 16, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    for k in range(8):
        own = words[k::8]
        own[:] = raw[k : k + 8 * len(own)].view("<u8")
    h = _mixed(words[:n]) * np.uint64(0xBF58476D1CE4E5B9)
    h += words[8 : n + 8]
    h = _mixed(h)
    h += words[16 : n + 16]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window's start, windows, anchor hash of each run of the texts (few enough to work on at once)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none
    h = gram_hashes(b"".join(texts) + bytes(64), n)
    least = h & ~_PLACE
    least |= np.arange(n, dtype=np.uint64)
    width, goal = 1, length - GRAM + 1
    while 2 * width <= goal:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if goal > width:
        least = np.minimum(least[: -(goal - width)], least[goal - width :])
    edges = np.zeros(n + 1, np.int8)
    enough = sizes >= length
    np.add.at(edges, offsets[enough], 1)
    np.add.at(edges, offsets[enough] + sizes[enough] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(edges[: len(least)], dtype=np.int8))
    if not len(windows):
        return none, none, none, none
    anchor = (least[windows] & _PLACE).astype(np.int64)
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], cuts])
    counts = np.diff(np.concatenate([first, [len(windows)]]))
    starts = windows[first]
    text = np.searchsorted(offsets, starts, "right") - 1
    # texts without bytes share an offset with the one that follows; the last of equals is meant
    return text, starts - offsets[text], counts, h[anchor[first]].view(np.int64)


def portions(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts dealt into portions of about AT_ONCE bytes: numbers, offsets and pieces. A longer text is cut into pieces that overlap by length - 1 bytes, so every window is in one piece."""
    numbers, offsets, pieces, n = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), AT_ONCE):
            piece = text[at : at + AT_ONCE + length - 1] if at or len(text) > AT_ONCE + length - 1 else text
            if pieces and n + len(piece) > AT_ONCE + length:
                yield numbers, offsets, pieces
                numbers, offsets, pieces, n = [], [], [], 0
            numbers.append(k)
            offsets.append(at)
            pieces.append(piece)
            n += len(piece)
    if pieces:
        yield numbers, offsets, pieces


def places(texts: list[bytes], anchor: np.ndarray) -> np.ndarray:
    """Where each text has the first string whose hash is its anchor; every text has one."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    hits = np.flatnonzero(gram_hashes(b"".join(texts) + bytes(64), int(sizes.sum())).view(np.int64) == np.repeat(anchor, sizes))
    return hits[np.searchsorted(hits, base)] - base
