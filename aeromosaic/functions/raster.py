"""NumPy on one tile at a time, and the small adapter between Arrow rows and tiles."""

import numpy as np
import pyarrow as pa


def as_image(buffer, h: int, w: int, channels: int = 3) -> np.ndarray:
    return np.frombuffer(buffer, dtype=np.uint8).reshape(h, w, channels)


def per_row(fn, schema: pa.Schema):
    """mapInArrow function from ``fn(row dict) -> iterable of row dicts``, one tile at a time."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(fn({n: batch.column(n)[k].as_py() for n in batch.schema.names}))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def shrink_area(image: np.ndarray, new_h: int, new_w: int) -> np.ndarray:
    """Area average: every target pixel is the mean of the source area it covers."""

    def weights(old, new):
        edges = np.arange(new + 1) * (old / new)
        cells = np.arange(old)
        cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
        return np.clip(cover, 0, None) * (new / old)

    rows, cols = weights(image.shape[0], new_h), weights(image.shape[1], new_w)
    mean = np.einsum("yr,rxc->yxc", rows, image.astype(np.float64), optimize=True)
    mean = np.einsum("xs,ysc->yxc", cols, mean, optimize=True)
    # halves go up; the small term keeps exact halves from falling through float noise
    return np.clip(np.floor(mean + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def bilinear(image: np.ndarray, x0: int, y0: int, sx, sy, clamp=None):
    """Values at (sx, sy) of an image whose first pixel is (x0, y0), and their coverage.

    Outside is zero (coverage counts the part inside), or, with ``clamp`` =
    (width, height), coordinates are held inside the frame first.
    """
    if clamp is not None:
        sx, sy = np.clip(sx, 0, clamp[0] - 1), np.clip(sy, 0, clamp[1] - 1)
    fx, fy = np.floor(sx), np.floor(sy)
    ax, ay = sx - fx, sy - fy
    h, w = image.shape[:2]
    value, cover = np.zeros((*sx.shape, image.shape[2])), np.zeros(sx.shape)
    for dy, wy in ((0, 1 - ay), (1, ay)):
        for dx, wx in ((0, 1 - ax), (1, ax)):
            px, py = fx.astype(np.int64) + dx - x0, fy.astype(np.int64) + dy - y0
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            weight = np.where(inside, wx * wy, 0.0)
            value += image[np.where(inside, py, 0), np.where(inside, px, 0)] * weight[..., None]
            cover += weight
    return value, cover


def label_regions(mask: np.ndarray, eight: bool) -> tuple[np.ndarray, dict]:
    """Connected regions of a mask by runs: label image (-1 outside) and run table.

    A label is the number of the region's first run in reading order.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1] - 1
    reach, pitch = int(eight), w + 4
    first = np.searchsorted(row * pitch + end, (row + 1) * pitch + start - reach)
    last = np.searchsorted(row * pitch + start, (row + 1) * pitch + end + reach, side="right")
    touching = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), touching)
    b = np.arange(touching.sum()) - np.repeat(np.cumsum(touching) - touching, touching)
    b = b + np.repeat(first, touching)
    label = np.arange(len(row))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label != label[label]).any():
            label = label[label]
    image = np.full((h, w), -1, dtype=np.int64)
    length = end - start + 1
    at = np.repeat(row * w + start, length)
    at = at + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    image.ravel()[at] = np.repeat(label, length)
    return image, {"row": row, "start": start, "end": end, "label": label}
