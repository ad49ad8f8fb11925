"""Decision trees on coded rows, in numpy: what a task of :mod:`emporion.operators.grow` runs.

A row is a record of small unsigned integers, one code for each column and, last, ``2 * w + y``: its label
``y`` and how often the tree draws it.  A categorical column's code is its level, each level is a slot (its
one-hot cell), and a row goes right of a split by that slot if it has the level.  A numeric column is one
slot, its code the number of cuts below the value; a row goes right if its code is over the split's cut.

A node looks at ``picks`` slots drawn by a hash of (seed, tree, node) and takes the split that lowers the
weighted Gini impurity most; it is a leaf if none lowers it, if it holds one class, or at the depth limit.
Counts are integers, so a tree depends neither on the order of its rows nor on who counts them.  Node ids are
those of a heap: 0 is the root, the children of i are 2i + 1 and 2i + 2.

The functions are sent to the executors by value, which need no copy of this package.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 17  # a node of more is split by itself
GAIN = 1e-12  # a split that lowers the impurity by less, relative to it, is rounding


@dataclass(frozen=True)
class Layout:
    """The columns of a record.  ``sizes``: codes of each column; ``slots``: the first slot of each;
    ``numeric``: whether it is one slot."""

    sizes: tuple[int, ...]
    slots: tuple[int, ...]
    numeric: tuple[bool, ...]
    n_slots: int
    picks: int
    seed: int
    class_weights: tuple[float, float]
    max_depth: int

    @property
    def dtype(self):
        return np.dtype(np.uint8 if max(self.sizes) <= 256 else np.uint16 if max(self.sizes) <= 65536 else np.uint32)

    def by_slot(self):
        """Column of each slot and its level, -1 for a numeric one."""
        column, level = np.zeros(self.n_slots, np.int32), np.full(self.n_slots, -1, np.int32)
        for c, (first, num) in enumerate(zip(self.slots, self.numeric)):
            end = first + 1 if num else (self.slots + (self.n_slots,))[c + 1]
            column[first:end] = c
            if not num:
                level[first:end] = np.arange(end - first)
        return column, level


def mixed(x):
    """A hash of 64 bits (the last step of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(*numbers) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for n in numbers:
        with np.errstate(over="ignore"):
            out = mixed(out + np.uint64(0x9E3779B97F4A7C15) + np.uint64(n % 2**64))
    return out[0]


def poisson_table():
    """How often a row is drawn, by 16 bits of its hash: Poisson with mean 1, that is a bootstrap."""
    p = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(p, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def draws(keys, tree, seed, table):
    with np.errstate(over="ignore"):
        return table[(mixed(keys + salt(seed, tree, 1)) >> np.uint64(48)).astype(np.uint16)]


def picked(ids, tree, lay: Layout):
    """The slots that each node looks at: a subset of fixed size, drawn without replacement (Floyd)."""
    n, k = lay.n_slots, lay.picks
    base = mixed(ids.astype(np.uint64) + salt(lay.seed, tree, 2))
    out = np.empty((len(ids), k), np.int32)
    for i, j in enumerate(range(n - k, n)):
        with np.errstate(over="ignore"):
            bits = mixed(base + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) >> np.uint64(32)
        at = ((bits * np.uint64(j + 1)) >> np.uint64(32)).astype(np.int32)
        taken = (out[:, :i] == at[:, None]).any(1)
        out[:, i] = np.where(taken, j, at)
    return out


def impurity(a, b):
    """Weight times Gini impurity of class weights a and b."""
    both = a + b
    return np.divide(2 * a * b, both, out=np.zeros_like(both), where=both > 0)


def lowered(n0, n1, left0, left1, cw):
    """By how much a split lowers the impurity, weights of the rows counted."""
    parts = impurity(cw[0] * left0, cw[1] * left1) + impurity(cw[0] * (n0 - left0), cw[1] * (n1 - left1))
    return impurity(cw[0] * n0, cw[1] * n1) - parts


def one_hot_counts(cols, node, y, w, S, column, level, lay: Layout):
    """Drawn rows on the right of each node's picked one-hot slots, by class.  ``node`` is each row's node, or
    one past the last for a row that is done."""
    k, f = S.shape
    keys, ws = [], []
    of = column[S]
    for c, (size, num) in enumerate(zip(lay.sizes, lay.numeric)):
        at, j = ((), ()) if num else np.nonzero(of == c)
        if len(at):
            place = np.zeros((k + 1, size), np.uint8 if f < 255 else np.int32)
            place[at, level[S[at, j]]] = j + 1
            r = place.ravel().take(node * size + cols[c])
            hit = np.flatnonzero(r != 0)
            keys.append(((node[hit].astype(np.int64) * f + r[hit] - 1) << 1) | y[hit])
            ws.append(w[hit])
    if not keys:
        return np.zeros((k, f, 2), np.int64)
    counts = np.bincount(np.concatenate(keys), np.concatenate(ws), minlength=2 * k * f)
    return counts.astype(np.int64).reshape(k, f, 2)


def code_counts(codes, q, k, y, w, size):
    """Drawn rows by (node, code, class)."""
    return np.bincount(((q * np.int64(size) + codes) << 1) | y, w, minlength=2 * k * size).astype(np.int64).reshape(k, size, 2)


def best_cut(counts, n0, n1, cw):
    """Gain and cut of each node from its counts by code; the lowest of equal cuts."""
    if counts.shape[1] < 2:
        return np.zeros(len(counts)), np.zeros(len(counts), np.int64)
    left = counts.cumsum(1)[:, :-1]
    gain = lowered(n0[:, None], n1[:, None], left[..., 0], left[..., 1], cw)
    cut = gain.argmax(1)
    return gain[np.arange(len(cut)), cut], cut


def best_cut_of_few(key, k, n0, n1, size, cw):
    """The same for nodes of few rows, from ``(node * size + code) << 16 | 2 * w + y`` of each."""
    key = np.sort(key)
    at, y, w = key >> 16, key & 1, (key & 0xFFFF) >> 1
    of = at // size
    sum0, sum1 = np.cumsum(w * (1 - y)), np.cumsum(w * y)
    first = np.searchsorted(of, np.arange(k))
    i = np.flatnonzero((at[1:] != at[:-1]) & (of[1:] == of[:-1]))
    gain, cut = np.zeros(k), np.zeros(k, np.int64)
    if len(i):
        o = of[i]
        before0, before1 = np.append(0, sum0)[first], np.append(0, sum1)[first]
        g = lowered(n0[o], n1[o], sum0[i] - before0[o], sum1[i] - before1[o], cw)
        edge = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        most = np.repeat(np.maximum.reduceat(g, edge), np.diff(np.append(edge, len(o))))
        top = np.flatnonzero(g == most)
        top = top[np.append(True, o[top][1:] != o[top][:-1])]
        gain[o[top]], cut[o[top]] = g[top], at[i[top]] - o[top] * size
    return gain, cut


def decided(n0, n1, S, right, cuts, column, level, lay: Layout):
    """Slot (-1: a leaf), cut and gain of each node from the counts of its picked slots.  ``cuts`` gives gain
    and cut for picked numeric slots."""
    gain = lowered(n0[:, None], n1[:, None], n0[:, None] - right[..., 0], n1[:, None] - right[..., 1], lay.class_weights)
    gain[level[S] < 0] = 0
    cut = np.zeros(S.shape, np.int64)
    for at, j, g, k in cuts:
        gain[at, j], cut[at, j] = g, k
    best, row = gain.argmax(1), np.arange(len(S))
    most = gain[row, best]
    ok = most > GAIN * impurity(lay.class_weights[0] * n0, lay.class_weights[1] * n1)
    return np.where(ok, S[row, best], -1), np.where(ok, cut[row, best], 0), np.where(ok, most, 0.0)


def numeric_counts(S, column, lay: Layout):
    """Empty counts (code, class) for one node's picked numeric slots: by place among the picks."""
    return {j: (c, np.zeros((lay.sizes[c], 2), np.int64)) for j, c in enumerate(column[S[0]].tolist()) if lay.numeric[c]}


def add_counts(rec, S, right, by, column, level, lay: Layout):
    """Adds rows of one node to its counts."""
    cols = np.ascontiguousarray(rec.T)
    y, w, node = cols[-1] & 1, (cols[-1] >> 1).astype(float), np.zeros(len(rec), np.int32)
    right += one_hot_counts(cols, node, y, w, S, column, level, lay)
    for c, n in by.values():
        n += code_counts(cols[c], node, 1, y, w, lay.sizes[c])[0]


def split_of_one(rec, root, n0, n1, tree, lay: Layout):
    """:func:`decided` for one node of many rows."""
    column, level = lay.by_slot()
    S = picked(np.array([root], np.int64), tree, lay)
    right, by = np.zeros((1, S.shape[1], 2), np.int64), numeric_counts(S, column, lay)
    for i in range(0, len(rec), BLOCK_ROWS):
        add_counts(rec[i : i + BLOCK_ROWS], S, right, by, column, level, lay)
    n0, n1 = np.array([n0]), np.array([n1])
    cuts = [(np.zeros(1, int), np.array([j]), *best_cut(n[None], n0, n1, lay.class_weights)) for j, (_, n) in by.items()]
    return decided(n0, n1, S, right, cuts, column, level, lay)


def splits(cols, node, y, w, ids, n0, n1, tree, column, level, lay: Layout):
    """:func:`decided` for many nodes, from their rows in any order."""
    S, k = picked(ids, tree, lay), len(ids)
    right = one_hot_counts(cols, node, y, w, S, column, level, lay)
    of, cuts, few, pairs, widest = column[S], [], [], [], max([s for s, num in zip(lay.sizes, lay.numeric) if num], default=1)
    n_pairs = 0
    for c, (size, num) in enumerate(zip(lay.sizes, lay.numeric)):
        at, j = np.nonzero(of == c) if num and size > 1 else ((), ())
        if not len(at):
            continue
        many = n0[at] + n1[at] >= 2 * size
        order = np.argsort(~many, kind="stable")  # nodes with many rows first
        at, j, m = at[order], j[order], int(many.sum())
        number = np.full(k + 1, -1, np.int32)
        number[at] = np.arange(len(at))
        q = number.take(node)
        rows = np.flatnonzero(q >= 0)
        q = q[rows]
        if m:
            counted = q < m
            own, of_own = rows[counted], q[counted]
            counts = code_counts(cols[c][own], of_own, m, y[own], w[own], size)
            cuts.append((at[:m], j[:m], *best_cut(counts, n0[at[:m]], n1[at[:m]], lay.class_weights)))
            rows, q = rows[~counted], q[~counted]
        if len(at) > m:
            few.append((((q.astype(np.int64) + (n_pairs - m)) * widest + cols[c][rows]) << 16) | cols[-1][rows])
            pairs.append((at[m:], j[m:]))
            n_pairs += len(at) - m
    if pairs:
        at, j = (np.concatenate(x) for x in zip(*pairs))
        cuts.append((at, j, *best_cut_of_few(np.concatenate(few), n_pairs, n0[at], n1[at], widest, lay.class_weights)))
    return decided(n0, n1, S, right, cuts, column, level, lay)


def sides(slot, cut, column, level):
    """Of splits: column, and the lowest and highest code that goes right."""
    lev = level[slot].astype(np.int64)
    return column[slot], np.where(lev < 0, cut + 1, lev), np.where(lev < 0, (1 << 31) - 1, lev)


def share_of(n0, n1, lay: Layout):
    """The late class's share of the weights; NaN without rows."""
    a, b = lay.class_weights[0] * n0, lay.class_weights[1] * n1
    return np.divide(b, a + b, out=np.full(len(n0), np.nan), where=(n0 + n1) > 0)


def grown_together(parts, tree, lay: Layout, put):
    """Grows the trees below several nodes, (rows, id, depth, class counts) each, level by level; ``put`` gets
    ids, slots, cuts, shares and gains of all nodes.  Rows are never moved: each has the number of its node."""
    column, level = lay.by_slot()
    cols = np.ascontiguousarray(np.concatenate([p[0] for p in parts]).T)
    node = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    ids, depth, n0, n1 = (np.array(x) for x in list(zip(*parts))[1:])
    y, w = (cols[-1] & 1).astype(np.int32), (cols[-1] >> 1).astype(float)
    while len(ids):
        k = len(ids)
        slot, cut, gain = splits(cols, node, y, w, ids, n0, n1, tree, column, level, lay)
        put(ids, slot, cut, share_of(n0, n1, lay), gain)
        c, low, high = (x.astype(np.int32) for x in sides(np.maximum(slot, 0), cut, column, level))
        end = np.zeros(1, np.int32)  # for rows that are done
        x = cols.ravel().take(np.append(c, end).astype(np.int64).take(node) * cols.shape[1] + np.arange(cols.shape[1]))
        right = (x >= np.append(low, end).take(node)) & (x <= np.append(high, end).take(node))
        key = 2 * node + right
        counts = np.bincount(2 * key + y, w, minlength=4 * (k + 1))[: 4 * k].astype(np.int64).reshape(2 * k, 2)
        split = np.repeat(slot >= 0, 2)
        new = np.column_stack([2 * ids + 1, 2 * ids + 2]).ravel()
        below = np.repeat(depth + 1, 2)
        live = split & (counts[:, 0] > 0) & (counts[:, 1] > 0) & (below < lay.max_depth)
        done = split & ~live
        put(new[done], np.full(done.sum(), -1), np.zeros(done.sum(), int), share_of(*counts[done].T, lay), np.zeros(done.sum()))
        ids, depth, (n0, n1) = new[live], below[live], counts[live].T
        number = np.full(2 * k + 2, len(ids), np.int32)
        number[: 2 * k][live] = np.arange(len(ids))
        node = number.take(key)
        stay = node < len(ids)
        if np.count_nonzero(stay) < 0.8 * len(stay):
            rows = np.flatnonzero(stay)
            cols, node, y, w = cols.take(rows, axis=1), node[rows], y[rows], w[rows]


def grown(rec, tree, root, depth, lay: Layout):
    """The tree below ``root`` on its rows: slot, cut and late class's share of each node, in the order of their
    ids (the children of the i-th split are nodes 2i + 1 and 2i + 2), levels, and by how much each slot lowered
    the impurity.  A node of many rows is split by itself; smaller ones go on together."""
    column, level = lay.by_slot()
    found, small, held = [], [], 0

    def put(*nodes):
        found.append(nodes)

    n = np.bincount(rec[:, -1] & 1, rec[:, -1] >> 1, minlength=2).astype(np.int64)
    waiting = [(rec, root, depth, n[0], n[1])]
    del rec
    while waiting:
        rec, own, d, n0, n1 = waiting.pop()
        if not n0 or not n1 or d >= lay.max_depth:
            put(np.array([own]), np.array([-1]), np.array([0]), share_of(np.array([n0]), np.array([n1]), lay), np.zeros(1))
        elif len(rec) <= BLOCK_ROWS:
            small.append((rec, own, d, n0, n1))
            held += len(rec)
        else:
            slot, cut, gain = split_of_one(rec, own, n0, n1, tree, lay)
            put(np.array([own]), slot, cut, share_of(np.array([n0]), np.array([n1]), lay), gain)
            if slot[0] >= 0:
                c, low, high = (x[0] for x in sides(slot, cut, column, level))
                right = (rec[:, c] >= low) & (rec[:, c] <= high)
                one = rec.view(np.dtype((np.void, rec.shape[1] * rec.itemsize))).ravel()  # rows as units
                for side in (1, 0):
                    rows = one[right if side else ~right].view(rec.dtype).reshape(-1, rec.shape[1])
                    n = np.bincount(rows[:, -1] & 1, rows[:, -1] >> 1, minlength=2).astype(np.int64)
                    waiting.append((rows, 2 * own + 1 + side, d + 1, n[0], n[1]))
        del rec
        if small and (held >= BLOCK_ROWS or not waiting):
            grown_together(small, tree, lay, put)
            small, held = [], 0
    ids, slot, cut, share, gain = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(ids)
    ids, slot, cut, share, gain = ids[order], slot[order], cut[order], share[order], gain[order]
    inner = slot >= 0
    gains = np.bincount(slot[inner], gain[inner], minlength=lay.n_slots)
    return slot, cut, np.where(inner, np.nan, share), int(ids[-1] + 1).bit_length() - 1 - depth, gains


def children(slot):
    """The first of the two children of each split of :func:`grown`."""
    return 2 * np.cumsum(slot >= 0) - 1


def heap_ids(slot, root):
    """Node ids of :func:`grown`."""
    out, first = np.empty(len(slot), np.int64), children(slot)
    out[0] = root
    now = np.zeros(1, np.int64)
    while len(now):
        now = now[slot[now] >= 0]
        out[first[now]], out[first[now] + 1] = 2 * out[now] + 1, 2 * out[now] + 2
        now = np.column_stack([first[now], first[now] + 1]).ravel()
    return out


def walked(codes, slot, cut, lay: Layout):
    """The leaf of each row of ``codes``."""
    column, level = lay.by_slot()
    leaf = slot < 0
    c, low, high = sides(np.maximum(slot, 0), cut, column, level)
    nodes = np.empty((len(slot), 4), np.int32)  # column, codes that go right, first child; a leaf leads to itself
    nodes[:, 0], nodes[:, 1] = c, np.where(leaf, 1, low)
    nodes[:, 2] = np.where(leaf, 0, high)
    nodes[:, 3] = np.where(leaf, np.arange(len(slot)), children(slot))
    flat, width = codes.ravel(), codes.shape[1]
    out, who, now = np.zeros(len(codes), np.int32), np.arange(len(codes)), np.zeros(len(codes), np.int32)
    base = who * width
    while len(who):
        for _ in range(4):
            at = nodes.take(now, axis=0)
            x = flat.take(base + at[:, 0])
            now = at[:, 3] + ((x >= at[:, 1]) & (x <= at[:, 2]))
        ended = leaf.take(now)
        if ended.any():
            out[who[ended]] = now[ended]
            who, now, base = who[~ended], now[~ended], base[~ended]
    return out


def passed(codes, who, root, top, column, level):
    """The rows ``who`` at the nodes of the forest's top where they end: (node, rows) pairs.  ``top``: slot, cut
    and first child of each node, a negative slot where rows end."""
    slot, cut, first = top
    waiting = [(root, who)]
    while waiting:
        at, who = waiting.pop()
        if slot[at] < 0:
            yield at, who
            continue
        c, low, high = sides(slot[at : at + 1], cut[at : at + 1], column, level)
        x = codes[who, c[0]]
        right = (x >= low[0]) & (x <= high[0])
        for to, some in ((first[at], who[~right]), (first[at] + 1, who[right])):
            if len(some):
                waiting.append((to, some))
