"""Neighborhood operators on tiles with a rim: one shuffle each, numpy inside a tile."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame

from gridloom.grid import FACES, Grid, map_tiles, shifted


def offsets(radius: tuple[int, int, int], shape: str = "box") -> list[tuple[int, int, int]]:
    """Places of a structuring element: box, ball or cross."""
    spans = [range(-r, r + 1) for r in radius]
    out = []
    for d in itertools.product(*spans):
        scaled = [abs(x) / r if r else (0 if x == 0 else math.inf) for x, r in zip(d, radius)]
        if shape == "box" or shape == "cross" and sum(x != 0 for x in d) <= 1 or shape == "ball" and sum(s * s for s in scaled) <= 1:
            out.append(d)
    return out


def _reduce(block: np.ndarray, inside: np.ndarray, places, f, empty) -> np.ndarray:
    out = None
    for d in places:
        near = np.where(shifted(inside, *d, fill=False), shifted(block, *d, fill=empty), empty)
        out = near if out is None else f(out, near)
    return out


def _ends(dtype) -> tuple:
    return (np.iinfo(dtype).min, np.iinfo(dtype).max) if np.issubdtype(dtype, np.integer) else (-np.inf, np.inf)


def dilate_block(block, inside, places):
    return _reduce(block, inside, [tuple(-x for x in d) for d in places], np.maximum, _ends(block.dtype)[0])


def erode_block(block, inside, places):
    return _reduce(block, inside, places, np.minimum, _ends(block.dtype)[1])


def _apply(cells: DataFrame, grid: Grid, value: str, compute, rim, name: str | None, kind: str | None = None) -> DataFrame:
    out = name or value
    made = map_tiles(cells, grid, [value], {out: kind or dict(cells.dtypes)[value]}, lambda arrays, inside, first: {out: compute(arrays[value], inside)}, rim)
    if out == value:
        return cells.drop(value).join(made, "idx").select(*cells.columns)
    return cells.join(made, "idx")


def grayscale_dilate(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: dilate_block(b, i, places), radius, name)


def grayscale_erode(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: erode_block(b, i, places), radius, name)


def morphological_gradient(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    """The greatest value of the neighborhood minus the least."""
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: dilate_block(b, i, places) - erode_block(b, i, places), radius, name)


def white_top_hat(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    """value minus its opening."""
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: b - dilate_block(erode_block(b, i, places), i, places), tuple(2 * r for r in radius), name)


def black_top_hat(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    """The closing minus value."""
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: erode_block(dilate_block(b, i, places), i, places) - b, tuple(2 * r for r in radius), name)


def opening(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: dilate_block(erode_block(b, i, places), i, places), tuple(2 * r for r in radius), name)


def closing(cells, grid, value, radius=(1, 1, 1), shape="box", name=None):
    places = offsets(radius, shape)
    return _apply(cells, grid, value, lambda b, i: erode_block(dilate_block(b, i, places), i, places), tuple(2 * r for r in radius), name)


def binary_dilate(cells, grid, value, radius=(1, 1, 1), shape="ball", foreground=1, name=None):
    """Cells within the element of a foreground cell become foreground; others keep their value."""
    places = offsets(radius, shape)

    def compute(b, i):
        near = dilate_block((b == foreground).astype(np.int8), i, places)
        return np.where(near > 0, foreground, b).astype(b.dtype)

    return _apply(cells, grid, value, compute, radius, name)


def binary_erode(cells, grid, value, radius=(1, 1, 1), shape="ball", foreground=1, background=0, name=None):
    """Foreground cells with a background cell within the element become background; beyond the grid is foreground."""
    places = offsets(radius, shape)

    def compute(b, i):
        near = erode_block((b == foreground).astype(np.int8), i, places)
        return np.where((b == foreground) & (near == 0), background, b).astype(b.dtype)

    return _apply(cells, grid, value, compute, radius, name)


def median(cells, grid, value, radius=(1, 1, 1), name=None):
    """Median of the box; beyond the grid the nearest cell's value counts. Even counts don't occur."""
    places = offsets(radius)

    def compute(b, i):
        padded = _clamped(b, radius)
        return np.median(np.stack([padded[tuple(slice(r + d, r + d + n) for d, r, n in zip(p[::-1], radius[::-1], b.shape))] for p in places]), axis=0).astype(b.dtype)

    return _apply(cells, grid, value, compute, radius, name)


def _clamped(b: np.ndarray, radius: tuple[int, int, int]) -> np.ndarray:
    return np.pad(b, [(r, r) for r in radius[::-1]], mode="edge")


def gaussian_kernel(variance: float, spacing: float, error: float = 0.01, width: int = 32) -> np.ndarray:
    sigma = math.sqrt(variance) / spacing
    if sigma == 0:
        return np.ones(1)
    half = 1
    while half < width // 2 and math.erfc((half + 0.5) / (sigma * math.sqrt(2))) > error:
        half += 1
    x = np.arange(-half, half + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def discrete_gaussian(cells, grid, value, variance=(1.0, 1.0, 1.0), error=0.01, width=32, name=None):
    """Separable Gaussian with the nearest cell's value beyond the grid; axes of one cell are left alone."""
    kernels = [gaussian_kernel(v, s, error, width) if n > 1 else np.ones(1) for v, s, n in zip(variance, grid.spacing, grid.dims)]

    def compute(b, i):
        out = b.astype(np.float64)
        for axis, k in zip((2, 1, 0), kernels):
            r = len(k) // 2
            if r:
                padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
                out = sum(w * np.take(padded, range(j, j + b.shape[axis]), axis=axis) for j, w in enumerate(k))
        return out

    return _apply(cells, grid, value, compute, tuple(len(k) // 2 for k in kernels), name or f"{value}_smooth", "double")


def gradient_magnitude(cells, grid, value, name=None):
    """Norm of central differences; beyond the grid the nearest cell's value counts."""

    def compute(b, i):
        padded = np.pad(b.astype(np.float64), 1, mode="edge")
        total = 0.0
        for axis, (s, n) in enumerate(zip(grid.spacing[::-1], grid.dims[::-1])):
            if n > 1:
                inner = [slice(1, -1)] * 3
                up, down = list(inner), list(inner)
                up[axis], down[axis] = slice(2, None), slice(0, -2)
                total = total + ((padded[tuple(up)] - padded[tuple(down)]) / (2 * s)) ** 2
        return np.sqrt(total)

    return _apply(cells, grid, value, compute, 1, name or f"{value}_gradient", "double")


def binary_contour(cells, grid, value, foreground=1, background=0, full=False, name=None):
    """Foreground cells with a face (or any) neighbor that isn't; others become background."""
    places = [d for d in offsets((1, 1, 1)) if any(d)] if full else FACES

    def compute(b, i):
        fore = b == foreground
        edge = np.zeros(b.shape, dtype=bool)
        for d in places:
            edge |= ~shifted(fore, *d, fill=True) & shifted(i, *d, fill=False)
        return np.where(fore & edge, foreground, background).astype(b.dtype)

    return _apply(cells, grid, value, compute, 1, name)


def label_contour(cells, grid, value, background=0, full=False, name=None):
    """Cells with a neighbor of another label keep theirs; others become background."""
    places = [d for d in offsets((1, 1, 1)) if any(d)] if full else FACES

    def compute(b, i):
        edge = np.zeros(b.shape, dtype=bool)
        for d in places:
            edge |= (shifted(b, *d) != b) & shifted(i, *d, fill=False)
        return np.where(edge, b, background).astype(b.dtype)

    return _apply(cells, grid, value, compute, 1, name)


def zero_crossing(cells, grid, value, foreground=1, background=0, name=None):
    """Cells nearer to zero than a face neighbor of the other sign; of equal ones the one on the low side."""

    def compute(b, i):
        edge = np.zeros(b.shape, dtype=bool)
        for k, d in enumerate(FACES):
            other = shifted(b, *d)
            there = shifted(i, *d, fill=False)
            changes = (b < 0) & (other > 0) | (b > 0) & (other < 0) | (b == 0) & (other != 0) | (b != 0) & (other == 0)
            mine, theirs = np.abs(b), np.abs(other)
            edge |= there & changes & ((mine < theirs) | (mine == theirs) & (k >= 3))
        return np.where(edge, foreground, background)

    return _apply(cells, grid, value, compute, 1, name or f"{value}_zero", "int")


def erode_dilate_mask(cells, grid, mask, operation, iterations=1, axes=(True, True, True), name=None):
    """Binary growth or shrinking of a mask through faces of the chosen axes, several times; the rim follows the count."""

    def compute(b, i):
        m = b.astype(bool) & i
        for _ in range(iterations):
            new = m.copy()
            for d in FACES:
                if axes[next(k for k in range(3) if d[k])]:
                    if operation == "dilate":
                        new |= shifted(m, *d, fill=False)
                    else:
                        new &= shifted(m, *d, fill=True) | ~shifted(i, *d, fill=False)
            m = new & i
        return m

    return _apply(cells, grid, mask, compute, iterations, name)


def _majority(features: np.ndarray, inside: np.ndarray, axes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the face (number in FACES) whose feature above 0 is most frequent among faces, -1 if none; and
    that feature. Of equal counts the one that reaches the count first in the order of FACES."""
    near = np.stack([np.where(shifted(inside, *d, fill=False), shifted(features, *d), 0) if axes[next(k for k in range(3) if d[k])] else np.zeros_like(features) for d in FACES])
    best, count = np.full(features.shape, -1), np.zeros(features.shape, dtype=int)
    for k in range(6):
        so_far = sum((near[j] == near[k]).astype(int) for j in range(k + 1))
        better = (near[k] > 0) & (so_far > count)
        best[better] = k
        count = np.where(better, so_far, count)
    feature = np.where(best >= 0, np.take_along_axis(near, np.maximum(best, 0)[None], axis=0)[0], 0)
    return best, feature


def erode_dilate_bad_data(cells, grid, feature, operation, iterations=1, axes=(True, True, True), carry=()):
    """Bad cells (feature 0) grow into their neighbors (dilate) or shrink (erode), all columns of carry moving with them.

    Eroding, a bad cell takes the columns of its most frequent good face neighbor; dilating, a good cell with a bad face
    neighbor takes that neighbor's columns. Each iteration reads the one before.
    """
    columns = [feature, *carry]
    kinds = dict(cells.dtypes)

    def compute(arrays, inside, first):
        blocks = {c: arrays[c].copy() for c in columns}
        for _ in range(iterations):
            f = blocks[feature]
            if operation == "erode":
                face, _ = _majority(f, inside, axes)
                face = np.where((f == 0) & inside, face, -1)
            else:
                face = np.full(f.shape, -1)
                for k, d in enumerate(FACES):
                    if axes[next(a for a in range(3) if d[a])]:
                        bad = shifted(inside, *d, fill=False) & (shifted(f, *d) == 0)
                        face = np.where((f > 0) & inside & bad & (face < 0), k, face)
            new = {}
            for c in columns:
                out = blocks[c].copy()
                for k, d in enumerate(FACES):
                    out = np.where(face == k, shifted(blocks[c], *d), out)
                new[c] = out
            blocks = new
        return blocks

    made = map_tiles(cells, grid, columns, {c: kinds[c] for c in columns}, compute, iterations)
    rest = [c for c in cells.columns if c not in columns]
    return cells.select(*rest).join(made, "idx").select(*cells.columns)


def erode_dilate_coordination(cells, grid, feature, coordination=6, iterations=1, carry=()):
    """Cells with at least coordination face neighbors of the other kind (bad or good) change over, all at once:
    a bad cell takes its most frequent good neighbor, a good one becomes bad."""
    columns = [feature, *carry]
    kinds = dict(cells.dtypes)

    def compute(arrays, inside, first):
        blocks = {c: arrays[c].copy() for c in columns}
        for _ in range(iterations):
            f = blocks[feature]
            good = sum((shifted(f, *d) > 0) & shifted(inside, *d, fill=False) for d in FACES)
            bad = sum((shifted(f, *d) == 0) & shifted(inside, *d, fill=False) for d in FACES)
            face, _ = _majority(f, inside, (True, True, True))
            fill = (f == 0) & (good >= coordination) & inside
            lose = (f > 0) & (bad >= coordination) & inside
            new = {}
            for c in columns:
                out = np.where(lose, 0, blocks[c]).astype(blocks[c].dtype)
                for k, d in enumerate(FACES):
                    out = np.where(fill & (face == k), shifted(blocks[c], *d), out)
                new[c] = out
            blocks = new
        return blocks

    made = map_tiles(cells, grid, columns, {c: kinds[c] for c in columns}, compute, iterations)
    rest = [c for c in cells.columns if c not in columns]
    return cells.select(*rest).join(made, "idx").select(*cells.columns)


def curvature_flow(cells, grid, value, step=0.05, iterations=5, name=None, limited=None):
    """Level sets move with their curvature; limited: None, 'min_max' (by the sign of the ball's mean of radius 1)."""

    def compute(b, i):
        u = b.astype(np.float64)
        axes = [a for a in range(3) if grid.dims[2 - a] > 1]
        for _ in range(iterations):
            p = np.pad(u, 1, mode="edge")

            def at(**d):
                return p[tuple(slice(1 + d.get(k, 0), p.shape[a] - 1 + d.get(k, 0)) for a, k in enumerate("zyx"))]

            first = {a: (at(**{"zyx"[a]: 1}) - at(**{"zyx"[a]: -1})) / 2 for a in axes}
            second = {a: at(**{"zyx"[a]: 1}) - 2 * u + at(**{"zyx"[a]: -1}) for a in axes}
            square = sum(g * g for g in first.values())
            flow = sum(second[a] * (square - first[a] ** 2) for a in axes)
            for a, c in itertools.combinations(axes, 2):
                ka, kc = "zyx"[a], "zyx"[c]
                mixed = (at(**{ka: 1, kc: 1}) - at(**{ka: 1, kc: -1}) - at(**{ka: -1, kc: 1}) + at(**{ka: -1, kc: -1})) / 4
                flow = flow - 2 * first[a] * first[c] * mixed
            rate = np.divide(flow, square, out=np.zeros_like(u), where=square > 1e-9)
            if limited == "min_max":
                around = sum(at(**{"zyx"[a]: s}) for a in axes for s in (-1, 1)) / (2 * len(axes))
                rate = np.where(around < u, np.minimum(rate, 0), np.maximum(rate, 0))
            u = u + step * rate
        return u

    return _apply(cells, grid, value, compute, iterations, name or f"{value}_flow", "double")
