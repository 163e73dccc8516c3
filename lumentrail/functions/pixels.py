"""Pixel kernels on gray and RGB rasters, with numpy.

Each takes and returns arrays (rows by columns, 0 to 255); ``kernel_column``
runs one on a binary column of gray rasters in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least Laplacian variance of very sharp, sharp and soft images.
BLUR_CLASSES = ((500.0, "very_sharp"), (200.0, "sharp"), (50.0, "soft"), (0.0, "blurry"))


def luminance(rgb: np.ndarray) -> np.ndarray:
    """BT.601."""
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means onto a smaller grid, nearest onto a larger one."""
    def along(a: np.ndarray, n: int) -> np.ndarray:
        if a.shape[0] < n:
            return a[np.arange(n) * a.shape[0] // n]
        edges = np.arange(n + 1) * a.shape[0] / n
        sums = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        whole = np.minimum(edges.astype(int), a.shape[0] - 1)
        at = sums[whole] + a[whole] * (edges - whole)[:, None]
        return np.diff(at, axis=0) / (a.shape[0] / n)

    return along(along(np.asarray(gray, float), height).T, width).T


def dct_hash(gray: np.ndarray) -> str:
    """64 bits of the low frequencies of a 32x32 raster, against the median of all but the first; 16 hex digits."""
    n = 32
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * n))
    low = (basis @ resized(gray, n, n) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return f"{sum(1 << int(i) for i in np.flatnonzero(bits)):016x}"


def laplacian_variance(gray: np.ndarray) -> float:
    g = np.asarray(gray, float)
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def blur_class(gray: np.ndarray) -> str:
    v = laplacian_variance(gray)
    return next(name for least, name in BLUR_CLASSES if v >= least)


def exposure(gray: np.ndarray) -> dict[str, float]:
    """Mean, share of shadows (under 64) and of highlights (192 and over), from one histogram."""
    h = np.bincount(np.asarray(gray, np.uint8).ravel(), minlength=256)
    n = max(1, h.sum())
    return {"mean": float(h @ np.arange(256) / n), "shadows": float(h[:64].sum() / n), "highlights": float(h[192:].sum() / n)}


#: Exposure classes as (name, mean below or above, least share of shadows or highlights, score).
DARK_CLASSES = (("underexposed", 60, 0.7, 0.3), ("slightly_underexposed", 85, 0.5, 0.7))
BRIGHT_CLASSES = (("overexposed", 200, 0.7, 0.3), ("slightly_overexposed", 170, 0.5, 0.7))


def _exposed(gray: np.ndarray) -> tuple[str, float]:
    if not np.size(gray):
        return "unknown", 0.5
    e = exposure(gray)
    for name, mean, share, score in DARK_CLASSES:
        if e["mean"] < mean and e["shadows"] > share:
            return name, score
    for name, mean, share, score in BRIGHT_CLASSES:
        if e["mean"] > mean and e["highlights"] > share:
            return name, score
    return "balanced", 1.0


def exposure_class(gray: np.ndarray) -> str:
    """By mean brightness and the share of shadows or highlights."""
    return _exposed(gray)[0]


def contrast(gray: np.ndarray) -> float:
    return float(min(1.0, np.std(gray) / 80)) if np.size(gray) else 0.0


def noise(gray: np.ndarray) -> float:
    """Median (the upper of two) of the Laplacian's size at every second pixel, of 50, at most 1."""
    g = np.asarray(gray, float)
    if min(g.shape) < 3:
        return 0.0
    around = np.abs(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1])[::2, ::2].ravel()
    return float(min(1.0, np.partition(around, len(around) // 2)[len(around) // 2] / 50))


def dynamic_range(gray: np.ndarray) -> float:
    return float((int(np.max(gray)) - int(np.min(gray))) / 255.0) if np.size(gray) else 0.0


def quality(gray: np.ndarray) -> float:
    """0.30 sharpness (Laplacian variance of 1000), 0.20 exposure by class, 0.25 contrast, 0.15 low noise, 0.10 range; 0 for no pixels."""
    if not np.size(gray):
        return 0.0
    total = 0.3 * min(1.0, laplacian_variance(gray) / 1000) + 0.2 * _exposed(gray)[1] + 0.25 * contrast(gray) + 0.15 * (1 - noise(gray)) + 0.1 * dynamic_range(gray)
    return float(min(1.0, max(0.0, total)))


def dominant_color(rgb: np.ndarray) -> int:
    """The commonest colour of three bits a channel, packed."""
    q = np.asarray(rgb, np.uint8).reshape(-1, 3) >> 5
    codes = (q[:, 0].astype(int) << 6) | (q[:, 1].astype(int) << 3) | q[:, 2]
    c = int(np.argmax(np.bincount(codes, minlength=512)))
    return ((c >> 6) << 16) | (((c >> 3) & 7) << 8) | (c & 7)


def crop(image: np.ndarray, left: float, top: float, width: float, height: float) -> np.ndarray:
    h, w = image.shape[:2]
    return image[round(top * h) : max(round(top * h) + 1, round((top + height) * h)), round(left * w) : max(round(left * w) + 1, round((left + width) * w))]


def rotated(image: np.ndarray, quarter_turns: int) -> np.ndarray:
    return np.rot90(image, -quarter_turns)


def flipped(image: np.ndarray, horizontal: bool = True) -> np.ndarray:
    return image[:, ::-1] if horizontal else image[::-1]


def adjusted(image: np.ndarray, *, brightness: float = 0.0, contrast_: float = 0.0, gamma: float = 1.0, exposure_: float = 0.0) -> np.ndarray:
    """Tonal changes in a fixed order: exposure, brightness, contrast, gamma."""
    x = np.asarray(image, float) / 255 * 2.0**exposure_ + brightness
    x = np.clip((x - 0.5) * (1 + contrast_) + 0.5, 0, 1) ** (1 / gamma)
    return np.rint(x * 255).astype(np.uint8)


def saturated(rgb: np.ndarray, amount: float) -> np.ndarray:
    gray = luminance(rgb)[..., None]
    return np.rint(np.clip(gray + (rgb - gray) * (1 + amount), 0, 255)).astype(np.uint8)


def curve(points: list[tuple[float, float]]) -> np.ndarray:
    """A table of 256 values through points of 0 to 255."""
    xs, ys = zip(*sorted(points))
    return np.rint(np.clip(np.interp(np.arange(256), xs, ys), 0, 255)).astype(np.uint8)


def box_blur(gray: np.ndarray, radius: int) -> np.ndarray:
    g = np.pad(np.asarray(gray, float), radius, mode="edge")
    k = 2 * radius + 1
    sums = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]) / (k * k)


def mask_inverted(m: np.ndarray) -> np.ndarray:
    return 255 - m


def mask_union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def mask_without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 0, a).astype(a.dtype)


def greedy_ctc(logits: np.ndarray, alphabet: str, blank: int = 0) -> str:
    """Best symbol per step, repeats and blanks taken out."""
    best = np.argmax(logits, axis=1)
    kept = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
    return "".join(alphabet[i - 1 if i > blank else i] for i in kept if i != blank)


def hsl(rgb: np.ndarray) -> np.ndarray:
    """Hue (0 to 360), saturation and lightness (0 to 1) by pixel."""
    x = np.asarray(rgb, float) / 255
    high, low = x.max(-1), x.min(-1)
    light, range_ = (high + low) / 2, high - low
    sat = np.divide(range_, 1 - np.abs(2 * light - 1), out=np.zeros_like(range_), where=range_ > 0)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    safe = np.where(range_ > 0, range_, 1)
    hue = np.where(high == r, (g - b) / safe % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    return np.stack([np.where(range_ > 0, hue, 0), sat, light], -1)


def rgb_of(hsl_: np.ndarray) -> np.ndarray:
    """The inverse of :func:`hsl`."""
    h, s, l = (hsl_[..., k] for k in range(3))
    a = s * np.minimum(l, 1 - l)
    channel = lambda n: l - a * np.clip(np.minimum((n + h / 30) % 12 - 3, 9 - (n + h / 30) % 12), -1, 1)
    return np.rint(np.clip(np.stack([channel(0), channel(8), channel(4)], -1), 0, 1) * 255).astype(np.uint8)


def hue_adjusted(rgb: np.ndarray, centre: float, *, width: float = 45.0, hue: float = 0.0, saturation: float = 0.0, lightness: float = 0.0) -> np.ndarray:
    """Changes around one hue that fade out over ``width`` degrees (one channel of an eight-channel mixer)."""
    x = hsl(rgb)
    apart = np.abs((x[..., 0] - centre + 180) % 360 - 180)
    weight = np.clip(1 - apart / width, 0, 1) * (x[..., 1] > 0)
    x[..., 0] = (x[..., 0] + hue * weight) % 360
    x[..., 1] = np.clip(x[..., 1] * (1 + saturation * weight), 0, 1)
    x[..., 2] = np.clip(x[..., 2] + lightness * weight, 0, 1)
    return rgb_of(x)


def warmed(rgb: np.ndarray, amount: float) -> np.ndarray:
    """Red up and blue down by a share of the range."""
    shift = np.array([amount, 0, -amount]) * 30
    return np.rint(np.clip(np.asarray(rgb, float) + shift, 0, 255)).astype(np.uint8)


def sharpened(gray: np.ndarray, amount: float, radius: int = 1) -> np.ndarray:
    """Unsharp mask."""
    g = np.asarray(gray, float)
    return np.rint(np.clip(g + amount * (g - box_blur(g, radius)), 0, 255)).astype(np.uint8)


def vignetted(gray: np.ndarray, amount: float) -> np.ndarray:
    h, w = gray.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    r = np.hypot((x - (w - 1) / 2) / max(1, w / 2), (y - (h - 1) / 2) / max(1, h / 2))
    t = np.clip((r - 0.5) / 0.9, 0, 1)
    return np.rint(gray * (1 - amount * t * t * (3 - 2 * t))).astype(np.uint8)


def grained(gray: np.ndarray, amount: float, seed: int) -> np.ndarray:
    noise_ = np.random.default_rng(seed).standard_normal(gray.shape) * 25 * amount
    return np.rint(np.clip(gray + noise_, 0, 255)).astype(np.uint8)


def faded(gray: np.ndarray, amount: float) -> np.ndarray:
    """Blacks lifted towards gray."""
    return np.rint(np.asarray(gray, float) * (1 - 0.4 * amount) + 255 * 0.2 * amount).astype(np.uint8)


def blended(image: np.ndarray, filtered: np.ndarray, strength: float) -> np.ndarray:
    return np.rint(np.asarray(image, float) * (1 - strength) + np.asarray(filtered, float) * strength).astype(np.uint8)


def auto_levels(gray: np.ndarray, clip: float = 0.01) -> np.ndarray:
    """Stretched between the quantiles ``clip`` and 1 - ``clip``."""
    low, high = np.quantile(gray, [clip, 1 - clip])
    return np.rint(np.clip((np.asarray(gray, float) - low) / max(1.0, high - low), 0, 1) * 255).astype(np.uint8)


def denoised(gray: np.ndarray) -> np.ndarray:
    """Median of 3 by 3."""
    g = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([g[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def _smooth(low: float, high: float, x: np.ndarray) -> np.ndarray:
    """From 0 at ``low`` to 1 at ``high``, flat at both ends."""
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def gaussian_blur(image: np.ndarray, radius: int) -> np.ndarray:
    """Weights out to ``radius``, whose deviation is two thirds of it; edges are repeated."""
    x = np.arange(-radius, radius + 1)
    weights = np.exp(-(x**2) / (2 * (radius * 2 / 3) ** 2))
    out = np.asarray(image, float)
    for axis in (0, 1):
        padded = np.pad(out, [(radius, radius) if k == axis else (0, 0) for k in range(out.ndim)], mode="edge")
        out = sum(w * np.take(padded, range(k, k + out.shape[axis]), axis=axis) for k, w in enumerate(weights / weights.sum()))
    return out


def _unsharp(x: np.ndarray, amount: float, share: float, least: int, most: int) -> np.ndarray:
    radius = int(np.clip(np.floor(max(x.shape[:2]) * share + 0.5), least, most))
    return x + amount * (x - gaussian_blur(x, radius))


def _vibrance(x: np.ndarray, value: float) -> np.ndarray:
    """Saturation for muted colours first, and less of it for skin."""
    high, low = x.max(-1), x.min(-1)
    muted = 1 - np.divide(high - low, high, out=np.zeros_like(high), where=high > 0)
    r, g, b = (x[..., k] for k in range(3))
    skin = (r >= 60) & (g >= 40) & (b >= 20) & (r > g) & (r > b) & (np.abs(r - g) >= 15) & (high - low >= 15)
    gray = luminance(x)[..., None]
    return gray + (x - gray) * (1 + value * muted * np.where(skin, 0.3, 1.0))[..., None]


def _from_centre(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[:2]
    rows, cols = np.mgrid[0:h, 0:w]
    return (np.hypot(cols - w / 2, rows - h / 2) / np.hypot(w / 2, h / 2))[..., None]


def _light(x: np.ndarray) -> np.ndarray:
    return (luminance(x) / 255)[..., None]


#: The fourteen tonal and colour adjustments in the order they are applied, each of a value from -1 to 1 (0: nothing).
ADJUSTMENTS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "exposure": lambda x, v: x * 2.0 ** (3 * v / 2.2),
    "brightness": lambda x, v: x + 50 * v,
    "contrast": lambda x, v: (x - 127.5) * (1 + 0.8 * v) + 127.5,
    "highlights": lambda x, v: x + 80 * v * _smooth(0.5, 1.0, _light(x)),
    "shadows": lambda x, v: x + 80 * v * (1 - _smooth(0.0, 0.5, _light(x))),
    "whites": lambda x, v: x + 40 * v * _smooth(0.7, 1.0, _light(x)),
    "blacks": lambda x, v: x + 40 * v * (1 - _smooth(0.0, 0.3, _light(x))),
    "temperature": lambda x, v: x + 30 * v * np.array([1, -0.1, -1]),
    "tint": lambda x, v: x + 30 * v * np.array([0.3, -1, 0.3]),
    "saturation": lambda x, v: luminance(x)[..., None] * -v + x * (1 + v),
    "vibrance": _vibrance,
    "clarity": lambda x, v: _unsharp(x, 0.6 * v, 0.02, 3, 15),
    "sharpness": lambda x, v: _unsharp(x, 1.5 * v, 0.005, 1, 5),
    "vignette": lambda x, v: x * (1 + 0.6 * v * _smooth(0.3, 1.0, _from_centre(x))),
}


def toned(rgb: np.ndarray, **values: float) -> np.ndarray:
    """An image under some of :data:`ADJUSTMENTS`, always in their order; colours are held within 0 and 255 after each."""
    if unknown := values.keys() - ADJUSTMENTS.keys():
        raise ValueError(f"no such adjustment: {sorted(unknown)}")
    x = np.asarray(rgb, float)
    for name, change in ADJUSTMENTS.items():
        if values.get(name):
            x = np.clip(change(x, values[name]), 0, 255)
    return np.rint(x).astype(np.uint8)


def _banded(value: float, bands: tuple[tuple[float, float, float], ...], rest: float) -> float:
    """The score of the first band (low, high, score) that holds a value."""
    return next((score for low, high, score in bands if low <= value <= high), rest)


#: Scores by width over height.
SCREEN_RATIOS = ((0.46, 0.56, 0.8), (-np.inf, 0.35 - 1e-12, 0.9), (0.7, 0.78, 0.6))


def _sampled(image: np.ndarray) -> np.ndarray:
    """About every pixel of a small image, fewer of a large one."""
    step = max(1, image.shape[0] * image.shape[1] // 10_000)
    return image[::step, ::step]


def screenshot_score(rgb: np.ndarray) -> float:
    """Mean of four signs of a screen: its format, few dominant colours, plain bars at top and bottom, a plain border around a varied middle. Over 0.6: a screenshot."""
    image = np.asarray(rgb, np.uint8)
    h, w = image.shape[:2]
    q = (_sampled(image) >> 4).astype(int).reshape(-1, 3)
    counts = np.unique(q @ np.array([256, 16, 1]), return_counts=True)[1]
    dominant = int((counts / counts.sum() > 0.05).sum())
    palette = 0.7 if 2 <= dominant <= 10 else 0.9 if dominant <= 2 else 0.2
    bar, red = max(1, h // 10), image[..., 0]
    plain = lambda rows: float(np.mean([len(set(r.tolist())) <= 3 for r in rows[:, :: max(1, w // 20)]]))
    bars = (plain(red[:bar]) + plain(red[h - bar :])) / 2
    border = np.concatenate([red[0, ::5], red[-1, ::5], red[::5, 0], red[::5, -1]]).astype(float)
    reach = min(w, h) // 4
    rows, cols = (np.arange(n // 2 - reach, n // 2 + reach + 1, 5) for n in (h, w))
    middle = red[np.ix_(rows[(rows >= 0) & (rows < h)], cols[(cols >= 0) & (cols < w)])].astype(float)
    content = 0.8 if border.var() < 50 and middle.var() > 200 else 0.5 if border.var() < 100 else 0.2
    return float(np.mean([_banded(w / h, SCREEN_RATIOS, 0.2), palette, bars, content]))


def looks_like_screen(width: int, height: int) -> bool:
    """By format alone: very tall, or a phone's."""
    return width / height < 0.35 or 0.45 < width / height < 0.56


def looks_like_page(width: int, height: int) -> bool:
    """By format alone: a sheet, upright or lying."""
    return 0.65 <= width / height <= 0.82 or 1.2 <= width / height <= 1.55


def document_score(rgb: np.ndarray) -> float:
    """Mean of four signs of a page: a sheet's format, a light ground, rows of edges, even colours. Over 0.6: a document."""
    image = np.asarray(rgb, np.uint8)
    image = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image
    h, w = image.shape[:2]
    ratios = (w / h, h / w)
    near = next((score for at, score in ((0.707, 0.9), (0.774, 0.85)) if any(abs(r - at) < 0.1 for r in ratios)), 0.6 if any(0.65 <= r <= 0.85 for r in ratios) else 0.1)
    sample = _sampled(image).astype(float).reshape(-1, 3)
    light = float((sample.mean(axis=1) > 200).mean())
    ground = 0.8 if 0.6 < light < 0.95 else 0.5 if light > 0.4 else 0.2
    dy, dx = max(1, h // 50), max(1, w // 50)
    rows, red = np.arange(dy, h - dy, dy), image[..., 0].astype(int)
    edges = (np.abs(red[rows - 1] - red[rows])[:, dx : w - dx : dx] > 30) if len(rows) else np.zeros((0, 0))
    density = float(edges.mean()) if edges.size else 0.0
    text = 0.7 if 0.1 < density < 0.5 else 0.4 if density > 0.05 else 0.1
    mean, spread = sample.mean(axis=0), float(sample.var(axis=0).sum())
    even = 0.8 if spread < 2000 and abs(mean[0] - mean[1]) + abs(mean[1] - mean[2]) < 30 else 0.5 if spread < 5000 else 0.2
    return float(np.mean([near, ground, text, even]))


def kernel_column(content: Column, width: Column, kernel: Callable[[np.ndarray], float], kind: str = "double") -> Column:
    """A kernel over gray rasters stored as bytes, row by row."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blobs, widths in batches:
            yield pd.Series([None if b is None else kernel(np.frombuffer(b, np.uint8).reshape(-1, int(w))) for b, w in zip(blobs, widths)])

    return run(content, width)
