"""Burrows-Wheeler transforms of string shards, and their merge by interleave refinement.

A shard's strings are sorted once, on their own. The merge then works on the transforms alone: it keeps, for every row
of every shard, the block of rows that share its first h symbols in the merged order, and refines the interleave with
the blocks of the rows h symbols further on, which the transform's own first-to-last mapping leads to. h doubles each
time. As rows of a shard stay in their order, refinement is a merge of sorted runs; suffixes aren't sorted again. Rows
in one block have a common prefix of the depth asked for, and block borders are where it is shorter.
"""

from __future__ import annotations

import numpy as np

#: Positions, ranks and ranks further on share one 64-bit key.
MOST = 1 << 21


def encode(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Strings as codes from 1 with a terminator 0 after each, and the bits of a code."""
    used = np.bincount(data, minlength=256) > 0
    wide = used.all()
    table = np.cumsum(used).astype(np.uint16 if wide else np.uint8)
    out = np.zeros(len(data) + len(lengths), table.dtype)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = table[data]
    return out, 9 if wide else 8


def _group(keys: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Flags of the places at which a new block starts."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | apart[1:]
    return new


def sort_suffixes(codes: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array; a terminator is smaller than all codes, and of two the earlier is smaller."""
    n, q, shift = len(codes), 40 // bits, np.uint64(MOST.bit_length() - 1)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(q):
        ahead = np.zeros(n, np.uint64)
        ahead[: n - i] = codes[i:]
        ahead[~open_] = 0
        open_ &= ahead > 0
        key = key << np.uint64(bits) | ahead
    place = np.arange(n, dtype=np.uint64)
    key = np.sort(key << shift | place)
    at = (key & np.uint64(MOST - 1)).astype(np.int64)
    new = _group(key >> shift, ~open_[at])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[at] = start
    h = q
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        todo = at[np.repeat(size > 1, size)]
        if not len(todo):
            break
        key = np.sort(rank[todo].astype(np.uint64) << (shift * np.uint64(2)) | rank[todo + h].astype(np.uint64) << shift | todo.astype(np.uint64))
        moved = (key & np.uint64(MOST - 1)).astype(np.int64)
        block = (key >> (shift * np.uint64(2))).astype(np.int64)
        new_part = _group(key >> shift, np.zeros(len(key), bool))
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        within = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        place_of = block + within
        at[place_of] = moved
        new[place_of] = new_part
        rank[moved] = np.maximum.accumulate(np.where(new_part, place_of, 0))
        h *= 2
    return at


def transform(codes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    return np.where(suffixes > 0, codes[suffixes - 1], 0).astype(codes.dtype)


def first_to_last(bwt: np.ndarray) -> np.ndarray:
    """From each row to that of the suffix one symbol shorter; rows of terminators lead to themselves."""
    step = np.argsort(bwt, kind="stable")
    ends = int(np.count_nonzero(bwt == 0))
    step[:ends] = np.arange(ends)
    return step


def merge(transforms: list[np.ndarray], bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, numbered through all shards, in merged order, and flags of those at which a new common prefix of ``depth`` starts."""
    base = np.cumsum([0, *map(len, transforms)])
    step = np.concatenate([first_to_last(x) + o for x, o in zip(transforms, base[:-1], strict=True)])
    symbol = np.concatenate([np.sort(x) for x in transforms]).astype(np.uint64)
    n, shift = len(step), np.uint64(MOST.bit_length() - 1)
    two = step[step]
    key = ((symbol << np.uint64(bits) | symbol[step]) << np.uint64(bits) | symbol[two]) << np.uint64(bits) | symbol[step[two]]
    known, power, powers = 4, two[two], {1: step, 2: two}
    row = np.arange(n, dtype=np.uint64)
    while True:
        order = np.sort(key << shift | row, kind="stable")
        merged = (order & np.uint64(MOST - 1)).astype(np.int64)
        new = _group(order >> shift, np.zeros(n, bool))
        if known >= depth:
            return merged, new
        block = np.empty(n, np.uint64)
        block[merged] = np.cumsum(new).astype(np.uint64) - np.uint64(1)
        powers[known] = power
        if 2 * known <= depth:
            ahead, power, known = power, power[power], 2 * known
        else:
            ahead, rest = None, depth - known
            for p, jump in powers.items():
                if rest & p:
                    ahead = jump if ahead is None else jump[ahead]
            known = depth
        key = block << shift | block[ahead]


def common_minimum(data: np.ndarray, lengths: np.ndarray, value: np.ndarray, depth: int, shards: int = 4) -> np.ndarray:
    """For each window of ``depth`` bytes, string by string: the smallest value of a string that holds the same bytes.

    ``value``: one of each string. Strings shorter than depth have no window.
    """
    codes, bits = encode(data, lengths)
    ends = np.cumsum(lengths + 1)
    if len(codes) > MOST:
        raise ValueError("too many symbols for one merge")
    cut = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1, shards) * len(codes) // shards), [len(lengths)]]))
    transforms, places = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        begin = ends[a - 1] if a else 0
        part = codes[begin : ends[b - 1]]
        suffixes = sort_suffixes(part, bits)
        transforms.append(transform(part, suffixes))
        places.append(suffixes + begin)
    merged, new = merge(transforms, bits, depth)
    place = np.concatenate(places)[merged]
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    room = np.repeat(ends, lengths + 1) - 1 - np.arange(len(codes))
    window = room[place] >= depth
    block = np.cumsum(new)[window]
    place = place[window]
    if not len(place):
        return np.zeros(0, value.dtype)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.repeat(np.minimum.reduceat(value[owner[place]], first), np.diff(np.append(first, len(place))))
    out = np.zeros(len(codes), value.dtype)
    out[place] = least
    return out[room >= depth]
