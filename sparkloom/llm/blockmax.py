"""Exact nearest vectors by cosine along an inverted index with block maxima.

Vectors are unit vectors without negative entries, in an order that puts like ones together, cut into
blocks. The lists of rare terms are short and followed in full. The entries of frequent terms are kept
by block, with the greatest of each block. What the rare terms give a block at most, plus the block
maxima of the frequent terms, bounds every cosine in it. The blocks of the greatest bounds are scored
first; the k-th best cosine in them is a threshold, and of the other blocks only those whose bound reaches
it are scored. This search sums in single precision; all that may be among the nearest is summed once
more in double precision, so that nothing hangs on blocks or batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Vectors in a block, and how many blocks are scored first.
BLOCK, FIRST = 64, 4
#: Terms of more than this share of the vectors are frequent, at most so many.
FREQUENT, MOST_FREQUENT = 0.02, 512
#: More than MOST_FREQUENT sums in single precision can be off for a cosine.
SLACK = 1e-4
#: Groups of like vectors for the order, and rounds to find them.
GROUPS, ROUNDS = 16, 5
#: Cosines that differ by less than this count as equal.
DIGITS = 12

Query = tuple[np.ndarray, np.ndarray]


def expanded(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after another, and the sizes of the ranges."""
    sizes = ends - begins
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins - upto + sizes, sizes), sizes


def groups_of(matrix: np.ndarray) -> np.ndarray:
    """A group of like rows for each row: a few rounds of spherical k-means from rows at even steps."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1
    step = max(1, -(-len(matrix) // GROUPS))
    centres = matrix[::step] / norms[::step]
    at = np.zeros(len(matrix), int)
    for _ in range(ROUNDS):
        at = (matrix @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            of = at == k
            if (mean := (matrix[of] / norms[of]).sum(axis=0)).any():
                centres[k] = mean / np.linalg.norm(mean)
    return at


class BlockMax:
    """``columns[begins[k] : begins[k + 1]]`` and as many ``weights`` are the k-th vector; ``kinds`` leads in the order.

    With ``exact``, which gives the weights of entries and their vectors, the weights themselves aren't kept."""

    def __init__(self, begins: np.ndarray, columns: np.ndarray, weights: np.ndarray, words: int, kinds: np.ndarray, exact: Callable | None = None):
        self.begins, self.columns = begins, columns
        self.exact = exact or (lambda entries, vectors: weights[entries])
        self.n, self.words = len(begins) - 1, words
        if not self.n:
            return
        rows = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(begins))
        df = np.bincount(columns, minlength=words)
        frequent = np.flatnonzero(df > FREQUENT * self.n)
        frequent = frequent[np.argsort(-df[frequent], kind="stable")][:MOST_FREQUENT]
        self.slot = np.full(words, -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        slot = self.slot[columns]
        often = np.flatnonzero(slot >= 0)
        matrix = np.zeros((self.n, len(frequent)), np.float32)
        matrix[rows[often], slot[often]] = weights[often]
        del often
        self.order = np.lexsort((np.diff(begins), groups_of(matrix), kinds))
        self.blocks = -(-self.n // BLOCK)
        # each block is laid out by itself, so that no second copy of the whole is made
        self.entries = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        for b in range(self.blocks):
            part = matrix[self.order[b * BLOCK : (b + 1) * BLOCK]]
            self.entries[b, :, : len(part)] = part.T
        del matrix
        self.maxima = self.entries.max(axis=2).T.copy()
        place = np.empty(self.n, np.int32)
        place[self.order] = np.arange(self.n, dtype=np.int32)
        rare = np.flatnonzero(slot < 0)
        del slot
        rare = rare[np.lexsort((place[rows[rare]], columns[rare]))]
        self.at, self.listed = place[rows[rare]], weights[rare].astype(np.float32)
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(columns[rare], minlength=words))])

    def search(self, queries: list[Query], k: int | None = None, least: float = 1e-12) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the cosines and positions of the ``k`` nearest of at least ``least``, or of all such:
        nearest first, then by position."""
        if not self.n or not queries:
            return [(np.zeros(0), np.zeros(0, int)) for _ in queries]
        wide = self.blocks * BLOCK
        often = np.zeros((len(queries), len(self.maxima)), np.float32)
        sums = np.zeros((len(queries), self.blocks, BLOCK), np.float32)
        for q, (columns, x) in enumerate(queries):
            slot = self.slot[columns]
            often[q, slot[slot >= 0]] = x[slot >= 0]
            columns, x = columns[slot < 0], x[slot < 0]
            where, sizes = expanded(self.lists[columns], self.lists[columns + 1])
            if len(where):
                sums[q] = np.bincount(self.at[where], self.listed[where] * np.repeat(x, sizes), wide).reshape(self.blocks, BLOCK)
        bounds = sums.max(axis=2) + often @ self.maxima

        def score(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)):
                q = np.flatnonzero(chosen[:, b])
                sums[q, b] += often[q] @ self.entries[b]

        threshold = np.full(len(queries), least)
        scored = np.zeros(bounds.shape, bool)
        if k and k <= FIRST * BLOCK < wide:
            first = np.argpartition(-bounds, FIRST - 1, axis=1)[:, :FIRST]
            np.put_along_axis(scored, first, True, axis=1)
            score(scored)
            best = np.take_along_axis(sums, first[:, :, None], axis=1).reshape(len(queries), -1)
            threshold = np.maximum(np.partition(best, -k, axis=1)[:, -k], least)
        reach = bounds >= (threshold - SLACK)[:, None]
        score(reach & ~scored)
        reach |= scored
        whole = np.zeros(self.words)
        out = []
        for q, (columns, x) in enumerate(queries):
            b = np.flatnonzero(reach[q])
            found = sums[q, b]
            inner = np.flatnonzero(found.ravel() >= threshold[q] - SLACK)
            if k and len(inner) > k:
                v = found.ravel()[inner]
                inner = inner[v >= np.partition(v, -k)[-k] - 2 * SLACK]
            at = b[inner // BLOCK] * BLOCK + inner % BLOCK
            at = self.order[at[at < self.n]]
            whole[columns] = x
            where, sizes = expanded(self.begins[at], self.begins[at + 1])
            exact = np.bincount(np.repeat(np.arange(len(at)), sizes), whole[self.columns[where]] * self.exact(where, np.repeat(at, sizes)), len(at))
            whole[columns] = 0
            exact = np.round(exact, DIGITS)
            order = np.lexsort((at, -exact))
            order = order[exact[order] >= least][:k]
            out.append((exact[order], at[order]))
        return out
