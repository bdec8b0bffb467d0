"""Deep-shallow sorting of suffixes: multikey quicksort down to a shallow depth, blind tries below it."""

from __future__ import annotations

SHALLOW = 32
KEY = 8


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 8:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    while x[low] == y[low]:
        low += 1
    return low


def blind_trie_order(strings: list[bytes], rows: list[int]) -> list[int]:
    """``rows`` in the order of their strings, by a trie whose nodes know only where and by which byte they branch.

    A string goes down by the branching bytes alone, is compared once with the leaf it arrives at, and
    hangs its own leaf where the two part. Short and long common prefixes cost the same one comparison.
    """
    root: list | None = None  # a leaf is [rows]; a node is (depth, {byte or -1 at an end: child})
    for row in rows:
        s = strings[row]
        if root is None:
            root = [row]
            continue
        node = root
        while isinstance(node, tuple):
            d, children = node
            node = children.get(s[d] if d < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0]]
        at = common(s, other)
        if at == len(s) == len(other):
            node.append(row)
            continue
        parent, key, node = None, 0, root
        while isinstance(node, tuple) and node[0] < at:
            parent, key = node, s[node[0]]
            node = node[1][key]
        own = s[at] if at < len(s) else -1
        if isinstance(node, tuple) and node[0] == at:
            node[1][own] = [row]
            continue
        new = (at, {other[at] if at < len(other) else -1: node, own: [row]})
        if parent is None:
            root = new
        else:
            parent[1][key] = new
    out, stack = [], [root] if root is not None else []
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Row numbers in the order of ``strings``; equal strings are neighbours."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            out += rows
            continue
        if depth >= shallow:
            out += blind_trie_order(strings, rows)
            continue
        keys = [strings[r][depth : depth + KEY] for r in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [r for r, k in zip(rows, keys, strict=True) if k < pivot]
        same = [r for r, k in zip(rows, keys, strict=True) if k == pivot]
        more = [r for r, k in zip(rows, keys, strict=True) if k > pivot]
        # A key that ends early is the string's end: all of ``same`` are then equal.
        stack += [(more, depth), (same, depth + KEY if len(pivot) == KEY else shallow), (less, depth)]
    return out
