"""Deep-shallow sorting of byte strings, with their common prefixes.

Multikey quicksort on words of 8 bytes orders the strings to a shallow depth. Groups that still agree there are ordered by a
blind trie each, which looks at one byte of each branching on the way down and compares one whole pair of strings at the end.
"""

from __future__ import annotations

import numpy as np

WORD = 8
#: Bytes that multikey quicksort looks at, and sizes of groups that go to a trie before.
SHALLOW_WORDS, SMALL_GROUP = 6, 16
END = -1  # sorts before every byte


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def blind_trie(strings: list[bytes], group: list[int]) -> list[tuple[int, int]]:
    """(member, bytes it shares with the one before) in order; 0 for the first."""
    # an inner node: [depth, {byte at that depth: child}]; a leaf: the members of one string, as a tuple
    root: list | tuple = (group[0],)
    for i in group[1:]:
        s = strings[i]
        node = root
        while isinstance(node, list):
            c = s[node[0]] if node[0] < len(s) else END
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        c, o = (x[shared] if shared < len(x) else END for x in (s, other))
        above, node = None, root
        while isinstance(node, list) and node[0] < shared:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == shared:
            node[1][c] = (*node[1].get(c, ()), i)  # a string that is there already ends here, so that its child is a leaf
            continue
        if c == o:  # the very same string
            new = (*node, i)
        else:
            new = [shared, {o: node, c: (i,)}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out: list[tuple[int, int]] = []
    todo = [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node, tuple):
            out += [(m, shared if k == 0 else len(strings[m])) for k, m in enumerate(node)]
        else:
            keys = sorted(node[1])
            todo += [(node[1][k], shared if k == keys[0] else node[0]) for k in reversed(keys)]
    return out


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and for each place in it the bytes shared with the string before (0 for the first)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = WORD * SHALLOW_WORDS
    padded = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(n, SHALLOW_WORDS)
    groups: list[np.ndarray] = []
    todo = [(np.arange(n), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= SMALL_GROUP or depth == SHALLOW_WORDS:
            groups.append(group)
            continue
        w = padded[group, depth]
        pivot = np.sort(w[:: len(w) // 9])[4]
        below, above = w < pivot, w > pivot
        parts = [(group[above], depth), (group[~(below | above)], depth + 1), (group[below], depth)]
        todo += [p for p in parts if len(p[0])]  # the lowest comes out first
    order, shared = np.empty(n, np.int64), np.empty(n, np.int64)
    at = 0
    for group in groups:
        for k, (m, lcp) in enumerate(blind_trie(strings, group.tolist())):
            order[at] = m
            shared[at] = lcp if k else common_prefix(strings[order[at - 1]], strings[m]) if at else 0
            at += 1
    return order, shared
