"""Suffix arrays of many short strings at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Three numbers of so many bits are packed into one 64-bit sort key.
BITS = 21
MOST = 1 << BITS
_LOW = np.uint64(MOST - 1)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes, each read to the end of its own string.

    Larsson-Sadakane refinement: suffixes are first ordered by four bytes; each round
    doubles the depth by ordering the members of every group that is still tied by the
    group of the suffix that many bytes on.  A group of one is never touched again.
    A suffix that ends sorts first; suffixes equal to the end keep their text order.
    `ends` has, for each position, the end of its string.
    """
    n = len(data)
    if n >= MOST:
        raise ValueError(f"{n} bytes do not fit into one suffix array")
    places = np.arange(n, dtype=np.int64)
    left = ends - places
    depth = 4
    head = np.zeros(n, np.uint64)
    for k in range(depth):
        # Bytes count from 1, so that the end of a string is less than any of them.
        byte = np.zeros(n, np.uint64)
        inside = left > k
        byte[inside] = data[places[inside] + k].astype(np.uint64) + np.uint64(1)
        head = head * np.uint64(257) + byte
    order, new = _sorted(head, places)
    # A group's number is that of its last place in the order, from 1.
    rank = np.empty(n, np.int64)
    last = _group_ends(new)
    rank[order] = last + 1
    longest = int(left.max(initial=0))
    open_places = np.flatnonzero(_tied(new))
    while depth < longest and len(open_places):
        members = order[open_places]
        onward = np.where(left[members] > depth, rank[np.minimum(members + depth, n - 1)], 0)
        group = rank[members]
        key = (group.astype(np.uint64) << np.uint64(2 * BITS)) | (onward.astype(np.uint64) << np.uint64(BITS))
        # The place within the text breaks ties, and comes back from the sorted key.
        key |= members.astype(np.uint64)
        key.sort()
        members = (key & _LOW).astype(np.int64)
        order[open_places] = members
        pair = key >> np.uint64(BITS)
        new = np.ones(len(key), bool)
        new[1:] = pair[1:] != pair[:-1]
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(key)) - 1
        rank[members] = np.repeat(open_places[stops] + 1, stops - starts + 1)
        open_places = open_places[_tied(new)]
        depth *= 2
    rank[order] = places
    return order, rank


def _sorted(head: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by 33-bit heads, then place; and where a new head begins."""
    spare = np.uint64(64 - 34)
    key = (head << spare) | places.astype(np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << spare) - np.uint64(1))).astype(np.int64)
    value = key >> spare
    new = np.ones(len(key), bool)
    new[1:] = value[1:] != value[:-1]
    return order, new


def _group_ends(new: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(new))
    return np.repeat(stops - 1, stops - starts)


def _tied(new: np.ndarray) -> np.ndarray:
    """Members of groups of more than one."""
    after = np.ones(len(new), bool)
    after[:-1] = new[1:]
    return ~(new & after)


def common_prefixes(
    data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray,
    starts: np.ndarray, lengths: np.ndarray,
) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order (0 elsewhere).

    Kasai's walk: from one position of a string to the next, the common prefix shrinks
    by one byte at most.  All strings are walked side by side; string i is walked over
    its first ``lengths[i]`` positions.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eights = np.ndarray(n + 1, "<u8", padded, strides=(1,))
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    height = np.zeros(len(starts), np.int64)
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
    for step, lanes in enumerate(active.tolist()):
        here = starts[:lanes] + step
        at = rank[here]
        first = at == 0
        other = order[np.maximum(at - 1, 0)]
        most = np.minimum(ends[here] - here, ends[other] - other)
        h = np.maximum(height[:lanes] - 1, 0)
        h[first] = 0
        most[first] = 0
        grow = np.flatnonzero(h < most)
        while len(grow):
            g = h[grow]
            apart = eights[here[grow] + g] ^ eights[other[grow] + g]
            lowest = np.maximum(apart & (~apart + np.uint64(1)), np.uint64(1))
            # The number of equal low bytes of two 8-byte words.
            same = np.where(apart == 0, 8, np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
            h[grow] = np.minimum(g + same, most[grow])
            grow = grow[(same == 8) & (h[grow] < most[grow])]
        out[here] = h
        height[:lanes] = h
    return out
