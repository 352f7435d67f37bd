"""Synthetic pictures with known truth, and small models to compare with."""

import numpy as np

from aeromosaic.schemas import FRAMES, MOSAIC


def ground(height, width, seed=1):
    """Smooth waves with blurred random blocks: enough texture for both detectors."""
    rng = np.random.default_rng(seed)
    blocks = rng.integers(0, 256, (height // 7 + 2, width // 7 + 2, 3)).astype(float)
    image = np.kron(blocks, np.ones((7, 7, 1)))[:height, :width]
    for axis in (0, 1):
        for _ in range(3):
            image = (np.roll(image, 1, axis) + 2 * image + np.roll(image, -1, axis)) / 4
    y, x = np.mgrid[0:height, 0:width]
    wave = 20 * np.sin(x / 31) + 20 * np.cos(y / 23)
    return np.clip(0.8 * image + 25 + wave[..., None], 2, 255).astype(np.uint8)


def frames_table(spark, images):
    rows = [
        (k, f"frame-{k:03d}", im.shape[0], im.shape[1], 3, 1.0, bytearray(np.ascontiguousarray(im).tobytes()))
        for k, im in enumerate(images)
    ]
    return spark.createDataFrame(rows, FRAMES)


def mosaic_table(spark, image, size, strip=0):
    height, width = image.shape[:2]
    rows = []
    for ty, y in enumerate(range(0, height, size)):
        for tx, x in enumerate(range(0, width, size)):
            part = np.ascontiguousarray(image[y : y + size, x : x + size])
            h, w = part.shape[:2]
            seen = bytearray(np.ones((h, w), dtype=np.uint8).tobytes())
            rows.append((strip, tx, ty, x, y, w, h, width, height, bytearray(part.tobytes()), seen))
    return spark.createDataFrame(rows, MOSAIC)


def picture(mosaic):
    """A mosaic table as one array (small ones, in tests only)."""
    rows = mosaic.collect()
    whole = np.zeros((rows[0].height, rows[0].width, 3), dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r.bgr, dtype=np.uint8).reshape(r.h, r.w, 3)
        whole[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = part
    return whole


def greedy(n, hops, skip):
    """The sequential walk: nearest successor, else the smallest frame not yet used."""
    used, chain, current = [False] * n, [0], 0
    used[0] = True
    while True:
        nearer = [current + s for s in range(1, skip + 1) if (current, current + s) in hops]
        if nearer:
            current = nearer[0]
        else:
            rest = [k for k in range(n) if not used[k]]
            if not rest:
                return chain
            current = rest[0]
        chain.append(current)
        used[current] = True
