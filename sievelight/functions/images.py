"""Image operators on NumPy arrays (height, width, channels; uint8), for Arrow batches.

No codec is needed: pixels come from the image source or from a column. Randomness is seeded by (seed, row, variant), so a
result depends on no batch or partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

#: Channel means and deviations of the usual normalisation.
MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def generator(seed: int, row: int, variant: str) -> np.random.Generator:
    digest = hashlib.sha256(f"{seed}|{row}|{variant}".encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "big"))


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _cubic(x: np.ndarray) -> np.ndarray:
    a = -0.5
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels by name, as functions of the distance in pixels, and how far they reach.
KERNELS = {"cubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def _weights(old: int, new: int, kernel: str) -> np.ndarray:
    """Weights (new x old) of a kernel, widened when shrinking so that every source pixel counts; pixels beyond its rounded reach have none."""
    shape, reach = KERNELS[kernel]
    scale = old / new
    width = max(scale, 1.0)
    centre = ((np.arange(new) + 0.5) * scale)[:, None]
    pixel = np.arange(old)[None, :]
    w = shape(np.abs(pixel + 0.5 - centre) / width)
    first, end = np.floor(centre - reach * width + 0.5), np.floor(centre + reach * width + 0.5)
    w = np.where((pixel >= first) & (pixel < end), w, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def scaled(img: np.ndarray, height: int, width: int, kernel: str = "cubic") -> np.ndarray:
    """Columns first, then rows, each rounded to whole levels, as image libraries do."""
    across = to_uint8(np.einsum("lk,jkc->jlc", _weights(img.shape[1], width, kernel), img.astype(np.float64)))
    return to_uint8(np.einsum("ij,jlc->ilc", _weights(img.shape[0], height, kernel), across.astype(np.float64)))


def resize(img: np.ndarray, scale: float) -> np.ndarray:
    """Down by ``scale`` and up again."""
    if scale >= 1:
        return img
    h, w = img.shape[:2]
    return scaled(scaled(img, max(1, round(h * scale)), max(1, round(w * scale))), h, w)


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, edges repeated."""
    if sigma <= 0:
        return img
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    x = np.pad(img.astype(np.float64), ((r, r), (r, r), (0, 0)), mode="edge")
    x = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, x)
    return to_uint8(np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, x))


def noise(img: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """Normal noise on [0, 1], clipped; fractions are cut off."""
    if sigma <= 0:
        return img
    x = img.astype(np.float32) / 255 + rng.normal(0, sigma, img.shape).astype(np.float32)
    return (np.clip(x, 0, 1) * 255).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0].astype(np.float64)
    return img[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def jitter(img: np.ndarray, amount: float, rng: np.random.Generator) -> np.ndarray:
    """Brightness, contrast, saturation, each by its own factor within 1 +- amount."""
    if amount <= 0:
        return img
    b, c, s = 1 + rng.uniform(-amount, amount, 3)
    x = to_uint8(img.astype(np.float64) * b)
    mean = np.floor(grey(x).mean() + 0.5)
    x = to_uint8(mean + (x.astype(np.float64) - mean) * c)
    g = np.rint(grey(x))[:, :, None]
    return to_uint8(g + (x.astype(np.float64) - g) * s)


def centre_crop(img: np.ndarray, keep: float) -> np.ndarray:
    if keep >= 1:
        return img
    h, w = img.shape[:2]
    nh, nw = max(1, round(h * keep)), max(1, round(w * keep))
    top, left = (h - nh) // 2, (w - nw) // 2
    return img[top : top + nh, left : left + nw]


def tiled(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """At least (height, width), by repeating the image."""
    h, w = img.shape[:2]
    return np.tile(img, (-(-max(height, h) // h), -(-max(width, w) // w), 1))[: max(height, h), : max(width, w)]


def reflected(img: np.ndarray, size: int) -> np.ndarray:
    """At least size x size, by reflection around the middle."""
    h, w = img.shape[:2]
    a, b = max(0, size - h), max(0, size - w)
    return np.pad(img, ((a // 2, a - a // 2), (b // 2, b - b // 2), (0, 0)), mode="reflect") if a or b else img


def box(img: np.ndarray, height: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """A box of this size at a random place of an image that is at least as large."""
    top, left = (int(rng.integers(room + 1)) for room in (img.shape[0] - height, img.shape[1] - width))
    return img[top : top + height, left : left + width]


def _any_square(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random square of half to all of the shorter side; of an image of up to 8 pixels, all of it."""
    shorter = min(img.shape[:2])
    side = int(rng.integers(shorter // 2, shorter + 1)) if shorter > 8 else shorter
    return box(img, side, side, rng)


#: What an image is cut to before it is brought to size, by mode.
CUTS = {"resize": lambda img, size, rng: img, "crop_then_resize": lambda img, size, rng: _any_square(img, rng), "random_crop": lambda img, size, rng: box(tiled(img, size, size), size, size, rng)}


def take_crop(img: np.ndarray, size: int, mode: str, rng: np.random.Generator) -> np.ndarray:
    if mode not in CUTS:
        raise ValueError(f"unknown mode {mode!r}")
    cut = CUTS[mode](img, size, rng)
    return cut if mode == "random_crop" else scaled(cut, size, size)


def fit(img: np.ndarray, size: int) -> np.ndarray:
    """The centre of a large image, a small one tiled, to size x size."""
    img = tiled(img, size, size)
    h, w = img.shape[:2]
    top, left = (h - size) // 2, (w - size) // 2
    return img[top : top + size, left : left + size]


def crops(img: np.ndarray, size: int, n: int, rng: np.random.Generator, pad: str = "reflect") -> list[np.ndarray]:
    """n random crops at native resolution; small images are padded by reflection or by tiles."""
    img = reflected(img, size) if pad == "reflect" else tiled(img, size, size)
    return [box(img, size, size, rng) for _ in range(n)]


def to_tensor(img: np.ndarray) -> np.ndarray:
    """Channels first, in [0, 1], normalised."""
    x = np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img[:, :, :3]
    return ((x.astype(np.float64) / 255 - MEAN) / STD).transpose(2, 0, 1)


def mean_intensity(img: np.ndarray) -> float:
    return float(grey(img).mean() / 255)


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def phash(img: np.ndarray) -> str:
    """64 bits of the low frequencies of the 32 x 32 grey image (by Lanczos) against their median (without the constant), as 16 hex digits."""
    small = scaled(to_uint8(grey(img))[:, :, None], 32, 32, "lanczos")[:, :, 0].astype(np.float64)
    c = _cosines(32)
    low = (c @ small @ c.T)[:8, :8].reshape(-1)
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


#: Degradations by family: (image, value, generator) -> image.
FAMILIES: dict[str, Callable[[np.ndarray, float, np.random.Generator], np.ndarray]] = {}


def family(name: str):
    """Register a degradation under a name; a registered name is not given twice."""

    def add(f):
        if name in FAMILIES:
            raise ValueError(f"family {name!r} is registered already")
        FAMILIES[name] = f
        return f

    return add


family("blur")(lambda img, value, rng: blur(img, value))
family("resize")(lambda img, value, rng: resize(img, value))
family("noise")(noise)
family("jitter")(jitter)
family("crop")(lambda img, value, rng: centre_crop(img, value))


@family("jpeg")
def _jpeg(img: np.ndarray, value: float, rng: np.random.Generator) -> np.ndarray:
    raise NotImplementedError("re-encoding needs a JPEG codec")


def degrade(img: np.ndarray, name: str, value: float | None, rng: np.random.Generator) -> np.ndarray:
    """An image after one degradation; ``clean`` and a missing value leave it as it is."""
    if name == "clean" or value is None:
        return img
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name!r}")
    return FAMILIES[name](img, value, rng)


def chain(img: np.ndarray, steps: list[tuple[str, float]], rng: np.random.Generator) -> np.ndarray:
    for name, value in steps:
        img = degrade(img, name, value, rng)
    return img
