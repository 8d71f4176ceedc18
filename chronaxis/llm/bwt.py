"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

Every string ends in a terminator of its own; terminators sort before all
characters and among themselves by string number.  A shard's transform comes
from sorting the shard's suffixes once.  Shards are merged without sorting
suffixes again: an interleave of their rows is refined by one character per
round, following each row's last character to the row of the longer suffix.
After h rounds the rows stand in the order of their first h characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """Rows of the sorted suffixes of a collection."""

    last: np.ndarray    # character before the suffix, 0 where the suffix is a whole string
    link: np.ndarray    # row of the suffix that is longer by this character
    string: np.ndarray  # string of the suffix
    start: np.ndarray   # where the suffix starts in its string
    count: int          # strings, which is also the number of rows for bare terminators


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys, and the rank of each."""
    order = np.argsort(keys, kind="stable")
    up = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.r_[0, up[1:] != up[:-1]]) if len(up) else 0
    return order, rank


def transform(rows: np.ndarray, sizes: np.ndarray) -> Transform:
    """Transform of strings given as padded rows of bytes below 255 and their sizes."""
    count, width = rows.shape
    lengths = sizes.astype(np.int64) + 1
    ends = np.cumsum(lengths)
    begins = ends - lengths
    total = int(ends[-1]) if count else 0
    inside = np.arange(width + 1)[None, :] < lengths[:, None]
    shown = np.zeros((count, width + 1), np.uint8)
    shown[:, :width] = rows + np.uint8(1)
    shown[np.arange(count), sizes] = 0
    text = shown[inside]
    string = np.repeat(np.arange(count), lengths)
    start = np.arange(total) - begins[string]
    remaining = lengths[string] - start  # with the terminator
    # Sort by doubled prefixes, from four characters on; past a terminator nothing counts.
    rank = np.zeros(total, np.int64)
    for k in range(min(4, total)):
        rank[:total - k] |= np.where(remaining[:total - k] > k, text[k:], 0).astype(np.int64) << (24 - 8 * k)
    order, rank = _ordered(rank)  # equal suffixes stay in string order
    reach = 4
    while reach < lengths.max(initial=1):
        further = np.zeros(total, np.int64)
        further[:max(total - reach, 0)] = rank[reach:] + 1
        further[remaining <= reach] = 0
        order, rank = _ordered(rank * (total + 1) + further)
        reach *= 2
    row_of = np.empty(total, np.int64)
    row_of[order] = np.arange(total)
    whole = start[order] == 0
    before = np.where(whole, 0, order - 1)
    last = np.where(whole, 0, text[before]).astype(np.uint8)
    link = np.where(whole, row_of[ends[string[order]] - 1], row_of[before])
    return Transform(last, link, string[order], start[order], count)


def merge(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all shards' rows by their first ``rounds`` characters.

    Returns, per merged row, the string (numbered through all shards) and the
    start of its suffix.
    """
    offsets = np.cumsum([0] + [len(s.last) for s in shards])
    last = np.concatenate([s.last for s in shards])
    link = np.concatenate([s.link + o for s, o in zip(shards, offsets)]).astype(np.int32)
    # Bare terminators open every order, by shard and then by string.
    head = np.concatenate([np.arange(o, o + s.count) for s, o in zip(shards, offsets)]).astype(np.int32)
    interleave = np.arange(len(last), dtype=np.int32)
    for _ in range(rounds):
        order = np.argsort(last[interleave], kind="stable")
        refined = link[interleave[order]]
        refined[:len(head)] = head
        if np.array_equal(refined, interleave):
            break
        interleave = refined
    strings = np.concatenate([s.string + b for s, b in zip(shards, np.cumsum([0] + [s.count for s in shards]))])
    return strings[interleave], np.concatenate([s.start for s in shards])[interleave]


def common_prefix_intervals(rows: np.ndarray, string: np.ndarray, start: np.ndarray, sizes: np.ndarray, length: int):
    """Rows of suffixes with at least ``length`` characters, and the interval of equal prefixes each lies in."""
    long = np.flatnonzero(sizes[string] - start >= length)
    string, start = string[long], start[long]
    same = np.ones(max(len(long) - 1, 0), bool)
    for k in range(length):
        c = rows[string, start + k]
        same &= c[1:] == c[:-1]
    return string, start, np.cumsum(np.r_[0, ~same]) if len(long) else np.zeros(0, np.int64)
