"""Of each hit the strongest one that it pairs with as a mirror image, without making the pairs.

Whether a hit is the image in any of its pairs follows from the strongest of its partners, as does whether it has one.
Partners lie on a few whole channels, and on each of them in one stretch of drifts; so a search in hits ordered by channel and
drift finds the stretch, and a table of the best of 1, 2, 4, ... neighbours its strongest hit. Work grows with hits
times their logarithm, however many lie on a channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    d = pa.chunked_array(column.chunks, column.type).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(d.dictionary).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[d.indices.to_numpy(zero_copy_only=False)]


def _first(test: Callable[[np.ndarray], np.ndarray], n: int, size: int) -> np.ndarray:
    """For n searches the first place below size where a test holds, which from there on holds at all; else size."""
    lo, hi = np.zeros(n, np.int64), np.full(n, size, np.int64)
    for _ in range(size.bit_length()):
        mid = (lo + hi) // 2
        open_, ok = lo < hi, test(np.minimum(mid, size - 1))
        hi, lo = np.where(open_ & ok, mid, hi), np.where(open_ & ~ok, mid + 1, lo)
    return lo


def stretches(drifts: np.ndarray, d: np.ndarray, asked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each d, from where to where the ordered distinct drifts are opposite to it: |sum| <= max(0.25, a tenth of the
    asking hit's). asked: d are of hits that are asked, and drifts of those that ask. NaN compares as in Spark."""
    def both(x):
        with np.errstate(invalid="ignore"):
            return x + d, np.maximum(0.25, np.abs(x if asked else d) * 0.1)

    usual = drifts[np.isfinite(drifts)]
    first = int(np.searchsorted(drifts, usual[0])) if len(usual) else 0
    if len(usual):
        def from_below(k):
            s, w = both(usual[k])
            return ~(s < -w)

        def above(k):
            s, w = both(usual[k])
            return s > w

        lo, hi = (_first(t, len(d), len(usual)) for t in (from_below, above))
        yield first + lo, first + np.where(np.isnan(d) & asked, lo, hi)
    for k in np.flatnonzero(~np.isfinite(drifts)):
        s, w = both(np.full(len(d), drifts[k]))
        yield np.full(len(d), k), k + (np.isnan(w) | (np.abs(s) <= w))


class Best:
    """The best of any stretch of ranks, and the best of another id, from tables of stretches of 1, 2, 4, ..."""

    def __init__(self, ranks: np.ndarray, ids: np.ndarray):
        self.ids = np.append(ids, -1)  # of each rank; the rank -1 is none
        self.levels = [(ranks, np.full(len(ranks), -1, np.int64))]

    def but(self, pair: tuple[np.ndarray, np.ndarray], of: np.ndarray) -> np.ndarray:
        return np.where(self.ids[pair[0]] != of, *pair)

    def joined(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum(a[0], b[0])
        of = self.ids[top]
        return top, np.maximum(self.but(a, of), self.but(b, of))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.levels) <= k:
            one, two = self.levels[-1]
            half = 1 << len(self.levels) - 1
            self.levels.append(self.joined((one[:-half], two[:-half]), (one[half:], two[half:])))
        return self.levels[k]

    def of(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The best rank from lo to before hi that is not of the own id; -1 if there is none."""
        out = np.full(len(lo), -1, np.int64)
        size = np.frexp(np.maximum(hi - lo, 0))[1] - 1  # -1: an empty stretch
        for k in np.unique(size[size >= 0]).tolist():
            some = np.flatnonzero(size == k)
            one, two = self.level(k)
            a, b = lo[some], hi[some] - (1 << k)
            out[some] = self.but(self.joined((one[a], two[a]), (one[b], two[b])), own[some])
        return out


def images(tol: int, ratio: float) -> Callable[[pa.Table], pa.Table]:
    """For rows (asks, file, at, drift, snr, hit_id) whose partners are among them: (hit_id, image) of those that have one."""

    def task(t: pa.Table) -> pa.Table:
        asks, at, drift, snr = (t.column(c).to_numpy() for c in ("asks", "at", "drift", "snr"))
        file, ids, null = codes(t.column("file")), codes(t.column("hit_id")), t.column("snr").is_null().to_numpy()
        asks = asks.astype(bool)
        value = np.where(null, -1, np.unique(snr, return_inverse=True)[1])  # NaN is the largest
        order = np.lexsort((ids, value))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        with np.errstate(invalid="ignore", over="ignore"):
            grows = ~null & (snr < snr * ratio)
        pair, image = np.zeros(len(t), bool), np.zeros(len(t), bool)
        for asked in (False, True):
            mine, theirs = np.flatnonzero(asks != asked), np.flatnonzero(asks == asked)
            if not len(mine) or not len(theirs):
                continue
            places, drifts = np.unique(at[theirs]), np.unique(drift[theirs])
            key = file[theirs] * len(places) + np.searchsorted(places, at[theirs])
            by = key * len(drifts) + np.searchsorted(drifts, drift[theirs])
            sort = np.argsort(by, kind="stable")
            by, theirs = by[sort], theirs[sort]
            best = Best(rank[theirs], ids[order])
            nulls, growing = (np.concatenate([[0], np.cumsum(x[theirs])]) for x in (null, grows))
            for lo, hi in stretches(drifts, drift[mine], asked):
                some = np.flatnonzero(lo < hi)
                x, lo, hi = mine[some], lo[some], hi[some]
                for step in range(-tol, tol + 1):
                    place = np.minimum(np.searchsorted(places, at[x] + step), len(places) - 1)
                    there = places[place] == at[x] + step
                    start = (file[x] * len(places) + place) * len(drifts)
                    a, z = np.searchsorted(by, start + lo), np.where(there, np.searchsorted(by, start + hi), 0)
                    r = best.of(a, z, ids[x])
                    met = np.flatnonzero(r >= 0)
                    i, j, a, z = x[met], order[r[met]], a[met], z[met]
                    pair[i] = True
                    with np.errstate(invalid="ignore", over="ignore"):
                        stronger = (value[j] > value[i]) | ((value[j] == value[i]) & (ids[j] > ids[i])) | (snr[i] < snr[j] * ratio)
                    stronger &= ~null[j]
                    image[i] |= np.where(null[i], growing[z] > growing[a], stronger | (grows[i] & (nulls[z] > nulls[a])))
        some = np.flatnonzero(pair)
        return pa.table({"hit_id": t.column("hit_id").take(pa.array(some)), "image": pa.array(image[some])})

    return task
