"""Suffix sorting by linear grouping construction (Baier 2015).

Phase 1 groups the suffixes by their longest Lyndon prefixes. Groups are processed in descending order: every suffix
of a group points to the previous suffix of a smaller group, and the suffixes pointed at leave their own group for a
new one right after it, the further the more often they are pointed at. Phase 2 goes through the final order from the
smallest suffix on and puts each suffix, whose Lyndon prefix ends where the current suffix starts, at the next place of
its group. No names are assigned anew and nothing recurs.

``sort_suffixes`` sorts one text; ``sort_many`` sorts many short ones in step, with array operations over the groups
that are current in all of them.
"""

from __future__ import annotations

import numpy as np


def sort_suffixes(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol is smaller than all others."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    group, pos, end = [0] * n, [0] * n, {}
    for i, s in enumerate(sa):
        pos[s] = i
        group[s] = i if not i or text[sa[i - 1]] != text[s] else group[sa[i - 1]]
        end[group[s]] = i + 1
    prev = [-1] * n
    cur = n
    while cur:
        g = group[sa[cur - 1]]
        seen: dict[int, int] = {}
        for s in sorted(sa[g:cur]):
            j = s - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[s] = j
            if j >= 0:
                seen[j] = seen.get(j, 0) + 1
        cur = g
        if not seen:
            continue
        last, first = None, {}
        for j in sorted(seen, key=lambda j: (group[j], -seen[j])):  # the most often pointed at go to the very end
            old = group[j]
            if old != last:
                last, start, tail = old, end[old], end[old]
                count = None
            if seen[j] != count:
                if count is not None:
                    end[tail] = start  # the class before is complete
                count, start = seen[j], tail
            tail -= 1
            p, other = pos[j], sa[tail]
            sa[tail], sa[p] = j, other
            pos[j], pos[other] = tail, p
            first.setdefault((old, count), []).append(j)
            end[old] = tail
        for (old, count), members in first.items():
            low = min(pos[j] for j in members)
            end[low] = low + len(members)
            for j in members:
                group[j] = low
    out, fill, placed = [0] * n, {}, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = fill.get(g, g)
            out[at] = j
            fill[g] = at + 1
            placed[j] = True
            j = prev[j]
    return out


def sort_many(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts that ``starts`` (with the end appended) cuts ``text`` into, as positions in ``text``.

    Symbols are whole numbers under 512; the last symbol of each text is smaller than all others of it.
    """
    n, low = len(text), starts[:-1]
    sizes = np.diff(starts)
    keys = np.repeat(np.arange(len(sizes)) * 512, sizes) + text
    sa = np.argsort(keys, kind="stable")
    pos = np.empty(n, dtype=np.int64)
    pos[sa] = np.arange(n)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(keys[sa]) != 0]))
    end = np.zeros(n + 1, dtype=np.int64)
    end[heads] = np.append(heads[1:], n)
    group = np.empty(n, dtype=np.int64)
    group[sa] = np.repeat(heads, np.diff(np.append(heads, n)))
    prev = np.full(n, -1, dtype=np.int64)
    moved = np.zeros(n, dtype=bool)
    cur, act = starts[1:].copy(), np.arange(len(sizes))
    while len(act):
        top = cur[act]
        g = group[sa[top - 1]]
        size = top - g
        suffixes = sa[ragged(g, size)]
        own = np.repeat(g, size)
        j = suffixes - 1
        j[j < np.repeat(low[act], size)] = -1
        prev[suffixes] = j
        wait = np.flatnonzero((j >= 0) & (group[j] >= own))
        while len(wait):
            to = prev[j[wait]]
            j[wait] = to
            prev[suffixes[wait]] = to
            wait = wait[(to >= 0) & (group[to] >= own[wait])]
        cur[act] = g
        act = act[g > low[act]]
        j = np.sort(j[j >= 0])
        if not len(j):
            continue
        head = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
        often = np.diff(np.append(head, len(j)))
        j = j[head]
        old = group[j]
        order = np.argsort(old * (n + 1) + often, kind="stable")
        j, old, often = j[order], old[order], often[order]
        change = old[1:] != old[:-1]
        by_group = np.flatnonzero(np.concatenate([[True], change]))
        by_class = np.flatnonzero(np.concatenate([[True], change | (often[1:] != often[:-1])]))
        number = np.diff(np.append(by_group, len(j)))
        tail = end[old[by_group]] - number
        slots = ragged(tail, number)
        moved[j] = True
        there = sa[slots]
        stay = there[~moved[there]]
        left = pos[j]
        left = left[left < np.repeat(tail, number)]
        sa[left] = stay
        pos[stay] = left
        sa[slots] = j
        pos[j] = slots
        moved[j] = False
        end[old[by_group]] = tail
        new = slots[by_class]
        number = np.diff(np.append(by_class, len(j)))
        end[new] = new + number
        group[j] = np.repeat(new, number)
    out = np.zeros(n, dtype=np.int64)
    fill, placed = np.arange(n), np.zeros(n, dtype=bool)
    out[low] = starts[1:] - 1
    placed[starts[1:] - 1] = True
    by_size = np.argsort(-sizes, kind="stable")
    low, sizes = low[by_size], sizes[by_size]
    act = len(low)
    for i in range(int(sizes[0]) if act else 0):
        while sizes[act - 1] <= i:
            act -= 1
        j = out[low[:act] + i] - 1
        ok = j >= low[:act]
        j = j[ok]
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            at = fill[g]
            out[at] = j
            fill[g] = at + 1
            placed[j] = True
            j = prev[j]  # -1 or another suffix of the same text
            j = j[j >= 0]
            j = j[~placed[j]]
    return out


def ragged(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (number[0] of them), first[1], ..."""
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(number)[:-1]])
    return np.repeat(first - before, number) + np.arange(number.sum())
