"""Numpy kernels on one dense block (z, y, x), the counterparts of the window filters."""

from __future__ import annotations

import numpy as np

from .windows import dog_factor, gaussian_weights


def running(v: np.ndarray, axis: int, r: int, op: np.ufunc, border: str = "edge") -> np.ndarray:
    """op over 2 r + 1 neighbours along an axis in time that doesn't depend on r; border values are repeated ("edge") or 0 ("constant").

    The line is cut into runs of 2 r + 1; a window is the end of one run and the beginning of the next."""
    if not r:
        return v
    n, k = v.shape[axis], 2 * r + 1
    v = np.moveaxis(v, axis, -1)
    padded = np.pad(v, [(0, 0)] * (v.ndim - 1) + [(r, r + -(n + 2 * r) % k)], mode=border)
    runs = padded.reshape(*v.shape[:-1], -1, k)
    head = op.accumulate(runs, -1).reshape(padded.shape)
    tail = op.accumulate(runs[..., ::-1], -1)[..., ::-1].reshape(padded.shape)
    out = op(tail[..., :n], head[..., k - 1 : k - 1 + n])
    if op is np.add:  # a window that is a whole run counts once
        out[..., ::k] = head[..., k - 1 : k - 1 + n : k]
    return np.moveaxis(out, -1, axis)


def running_within(v: np.ndarray, axis: int, r: int, op: np.ufunc) -> np.ndarray:
    """The same where NaN stands for voxels that aren't there: a line ends where its voxels do, with that value repeated."""
    missing = np.isnan(v)
    c, place = np.moveaxis(v, axis, -1), np.arange(v.shape[axis])
    there = ~np.moveaxis(missing, axis, -1)
    last = np.maximum.accumulate(np.where(there, place, -1), -1)
    first = np.minimum.accumulate(np.where(there, place, len(place))[..., ::-1], -1)[..., ::-1]
    nearest = np.where(last >= 0, last, np.where(first < len(place), first, place))
    whole = np.moveaxis(np.take_along_axis(c, nearest, -1), -1, axis)
    return np.where(missing, np.nan, running(whole, axis, r, op))


def erode(v: np.ndarray, r: tuple[int, int, int]) -> np.ndarray:
    for axis, k in zip((-1, -2, -3), r, strict=True):
        v = running(v, axis, k, np.minimum)
    return v


def dilate(v: np.ndarray, r: tuple[int, int, int]) -> np.ndarray:
    for axis, k in zip((-1, -2, -3), r, strict=True):
        v = running(v, axis, k, np.maximum)
    return v


def box(v: np.ndarray, r: tuple[int, int, int], border: str = "edge") -> np.ndarray:
    for axis, k in zip((-1, -2, -3), r, strict=True):
        v = running(v, axis, k, np.add, border) / (2 * k + 1)
    return v


def normalize(v: np.ndarray, r: tuple[int, int, int], small: tuple[int, int, int], least: float) -> np.ndarray:
    if 0 in r or 0 in small:
        return np.where(v >= least, v, 0.0)
    e, d = box(erode(v, r), small), box(dilate(v, r), small)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(v >= least, (v - e) / (d - e), 0.0)


def normalize_within(v: np.ndarray, r: tuple[int, int, int], small: tuple[int, int, int], least: float) -> np.ndarray:
    """Local contrast where NaN stands for voxels that aren't there. Passes take x, y and z, then z, y and x for the box, whose
    sums stay whole if the values are."""
    e = d = v
    for axis, k in zip((-1, -2, -3), r, strict=True):
        e, d = running_within(e, axis, k, np.minimum), running_within(d, axis, k, np.maximum)
    for axis, k in zip((-3, -2, -1), small[::-1], strict=True):
        e, d = running_within(e, axis, k, np.add), running_within(d, axis, k, np.add)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(v >= least, (v * np.prod([2 * k + 1 for k in small]) - e) / (d - e), 0.0)


def share(v: np.ndarray, r: tuple[int, int, int], least: float) -> np.ndarray:
    """The other mode's contrast: the whole value, not its distance from the eroded one, over the spread; the box sees zeros beyond the border."""
    e, d = box(erode(v, r), r, "constant"), box(dilate(v, r), r, "constant")
    with np.errstate(divide="ignore", invalid="ignore"):
        return (v >= least) * v / (d - e)


def hessian_one_sided(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """xx, xy, xz, yy, yz, zz where a border's derivative is its step to the one neighbour there is."""
    gz, gy, gx = np.gradient(v)
    gyz, gyy, _ = np.gradient(gy)
    gxz, gxy, gxx = np.gradient(gx)
    return gxx, gxy, gxz, gyy, gyz, np.gradient(gz, axis=0)


def gaussian(v: np.ndarray, sigma_xy: float, sigma_z: float) -> np.ndarray:
    for axis, sigma in ((2, sigma_xy), (1, sigma_xy), (0, sigma_z)):
        w = gaussian_weights(sigma)
        r = len(w) // 2
        padded = np.pad(v, [(r, r) if a == axis else (0, 0) for a in range(3)])
        n = v.shape[axis]
        v = sum(k * np.take(padded, range(j, j + n), axis=axis) for j, k in enumerate(w))
    return v


def difference_of_gaussians(v: np.ndarray, small: tuple[float, float], large: tuple[float, float], gamma: float = 1.0) -> np.ndarray:
    return (gaussian(v, *small) - gaussian(v, *large)) * dog_factor(*small, gamma)


def gradient(v: np.ndarray, axis: int) -> np.ndarray:
    p = np.pad(v, [(1, 1) if a == axis else (0, 0) for a in range(3)])
    n = v.shape[axis]
    return (np.take(p, range(2, n + 2), axis=axis) - np.take(p, range(n), axis=axis)) * 0.5


def hessian(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """xx, xy, xz, yy, yz, zz."""
    gx, gy, gz = gradient(v, 2), gradient(v, 1), gradient(v, 0)
    return gradient(gx, 2), gradient(gx, 1), gradient(gx, 0), gradient(gy, 1), gradient(gy, 0), gradient(gz, 0)


def negative_definite(h: tuple[np.ndarray, ...]) -> np.ndarray:
    xx, xy, xz, yy, yz, zz = h
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    return (xx < 0) & (xx * yy - xy * xy > 0) & (det < 0)


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the edges a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def touching(index: np.ndarray, height: int, width: int, wrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in the sorted array `index` of linear voxel numbers) that touch by face, edge or corner.

    With wrap, neighbours are plain steps in the linear number, so rows run on into each other."""
    z, rest = np.divmod(index, height * width)
    y, x = np.divmod(rest, width)
    left, right = [], []
    for dz, dy, dx in ((0, 0, 1), (0, 1, -1), (0, 1, 0), (0, 1, 1), *((1, j, i) for j in (-1, 0, 1) for i in (-1, 0, 1))):
        inside = np.ones(len(index), dtype=bool) if wrap else (y + dy >= 0) & (y + dy < height) & (x + dx >= 0) & (x + dx < width)
        at = np.flatnonzero(inside)
        want = index[at] + (dz * height + dy) * width + dx
        pos = np.searchsorted(index, want)
        hit = (pos < len(index)) & (index[np.minimum(pos, len(index) - 1)] == want)
        left.append(at[hit])
        right.append(pos[hit])
    return np.concatenate(left), np.concatenate(right)


def label_block(index: np.ndarray, height: int, width: int, wrap: bool = False) -> np.ndarray:
    """Label (smallest linear number of its component) of each voxel in the sorted array."""
    return index[merge_labels(len(index), *touching(index, height, width, wrap))] if len(index) else index
