"""Pixel functions as Arrow-batched UDFs: quality gate, blur, perceptual hash, descriptor matching and homographies.

Images are grey rows of bytes with their height and width; decoding belongs to the sources. Resampling is by area means, so hashes are
comparable with one another, not bit by bit with those of other resamplers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# fixed values: the quality gate
BLACK_MAX, BLACK_SHARE, SAMPLE, FLAT_MAX, FLAT_RANGE, BOTTOM = 16, 0.90, 256, 80, 16, 0.15


def grey(data: bytes, height: int, width: int) -> np.ndarray:
    """Grey values of an image that Spark's ``image`` source decoded (BGR, or one channel)."""
    x = np.frombuffer(data, np.uint8)
    channels = len(x) // max(1, height * width)
    x = x.reshape(height, width, channels).astype(float)
    return x[:, :, 0] if channels == 1 else np.rint(x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299)


def shrink(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means."""

    def means(a: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, len(a), n + 1)
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        low = np.minimum(edges.astype(int), len(a) - 1)
        at = sums[low] + (edges - low).reshape(-1, *[1] * (a.ndim - 1)) * a[low]
        return np.diff(at, axis=0) / (len(a) / n)

    return means(means(x, height).T, width).T


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(3 * sigma + 0.5)
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        x = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="edge"), k, "valid"), axis, x)
    return x


def quality(x: np.ndarray) -> tuple[str, str | None, float]:
    """(status, reason, share of near black) of grey values."""
    if not x.size:
        return "UNVERIFIABLE", "empty_image", 1.0
    scale = min(1.0, SAMPLE / max(x.shape))
    x = shrink(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))) if scale < 1 else x
    black = float((x <= BLACK_MAX).mean())
    if black >= BLACK_SHARE:
        return "UNVERIFIABLE", "near_black_dominant", black
    low, high = np.percentile(smooth(x[: max(1, int(len(x) * (1 - BOTTOM)))], 3.0), [10, 90])
    flat = high <= FLAT_MAX and high - low <= FLAT_RANGE
    return ("UNVERIFIABLE", "dark_flat_scene", black) if flat else ("VERIFIABLE", None, black)


def blur_variance(x: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; borders reflect without their own row."""
    if min(x.shape) < 2:
        return 0.0
    p = np.pad(x, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


_N = 32
_DCT = np.cos(np.pi / _N * (np.arange(_N) + 0.5)[None] * np.arange(_N)[:, None])


def dct_hash(x: np.ndarray) -> str:
    """64 bits in hex: which of the lowest 8 x 8 cosine coefficients of a 32 x 32 image are above their median."""
    c = (_DCT @ shrink(x, _N, _N) @ _DCT.T)[:8, :8]
    return f"{int(''.join('1' if b else '0' for b in (c > np.median(c)).ravel()), 2):016x}"


def mutual_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.75) -> np.ndarray:
    """Index pairs that are one another's nearest and pass the ratio test both ways; exact."""
    if len(a) < 2 or len(b) < 2:
        return np.zeros((0, 2), int)
    d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))

    def good(d):
        two = np.partition(d, 1, axis=1)[:, :2]
        return np.where(two[:, 0] < ratio * two[:, 1], d.argmin(1), -1)

    ab, ba = good(d), good(d.T)
    i = np.flatnonzero(ab >= 0)
    i = i[ba[ab[i]] == i]
    return np.stack([i, ab[i]], 1)


def fit_homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Least-squares homography of four points or more, on normalised coordinates."""

    def normal(p):
        c, s = p.mean(0), max(np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean(), 1e-9)
        k = np.sqrt(2) / s
        return np.array([[k, 0, -k * c[0]], [0, k, -k * c[1]], [0, 0, 1]])

    ta, tb = normal(a), normal(b)
    pa, pb = (np.c_[p, np.ones(len(p))] @ t.T for p, t in ((a, ta), (b, tb)))
    x, y, (u, v) = pa[:, 0], pa[:, 1], pb[:, :2].T
    o, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.c_[-x, -y, -one, o, o, o, u * x, u * y, u], np.c_[o, o, o, -x, -y, -one, v * x, v * y, v]])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def hull_area(p: np.ndarray) -> float:
    """Area of the convex hull; 0 of fewer than three points."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return 0.0

    def chain(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(chain(pts) + chain(pts[::-1]))
    return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)


def ransac(a: np.ndarray, b: np.ndarray, size_a: tuple[int, int], size_b: tuple[int, int], reach: float = 5.0, rounds: int = 500, seed: int = 0) -> tuple[int, float, float]:
    """(inliers, their share, the smaller of both sides' covered share); deterministic. Ends when a better sample is unlikely (1e-6)."""
    if len(a) < 4:
        return 0, 0.0, 0.0
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)

    def inside(h):
        q = np.c_[a, np.ones(len(a))] @ h.T
        w = np.where(np.abs(q[:, 2]) < 1e-12, 1e-12, q[:, 2])
        return ((q[:, :2] / w[:, None] - b) ** 2).sum(1) <= reach * reach

    for k in range(rounds):
        if k * np.log(1 - min(0.99, best.mean()) ** 4) < np.log(1e-6):
            break
        pick = rng.choice(len(a), 4, replace=False)
        h = fit_homography(a[pick], b[pick])
        if h is not None and np.isfinite(h).all() and (own := inside(h)).sum() > best.sum():
            best = own
            if best.all():
                break
    if best.sum() >= 4 and (h := fit_homography(a[best], b[best])) is not None and (own := inside(h)).sum() >= best.sum():
        best = own
    cover = min(hull_area(p[best]) / max(1, w * h) for p, (w, h) in ((a, size_a), (b, size_b)))
    return int(best.sum()), float(best.mean()), cover


@pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("near_black", T.DoubleType())]))
def quality_udf(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([quality(grey(d, h, w)) if d is not None and h > 0 else ("UNVERIFIABLE", "image_decode_failed", None) for d, h, w in zip(data, height, width)], columns=["status", "reason", "near_black"])


@pandas_udf(T.DoubleType())
def blur_variance_udf(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([blur_variance(grey(d, h, w)) if d is not None and h > 0 else None for d, h, w in zip(data, height, width)], dtype=float)


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def rotation_hashes_udf(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Hashes after turns of 0, 90, 180 and 270 degrees clockwise."""
    return pd.Series([{str(90 * k): dct_hash(np.rot90(grey(d, h, w), -k)) for k in range(4)} if d is not None and h > 0 else None for d, h, w in zip(data, height, width)])


@pandas_udf(T.StructType([T.StructField("inliers", T.IntegerType()), T.StructField("ratio", T.DoubleType()), T.StructField("coverage", T.DoubleType())]))
def homography_udf(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.DataFrame:
    """Of matched points (flat x, y arrays) and image sizes (width, height)."""
    pts = lambda x: np.asarray(x, float).reshape(-1, 2)
    return pd.DataFrame([ransac(pts(p), pts(q), tuple(s), tuple(t)) for p, q, s, t in zip(a, b, size_a, size_b)], columns=["inliers", "ratio", "coverage"])
