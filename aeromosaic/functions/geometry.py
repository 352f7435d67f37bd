"""3x3 transforms as array<double>(9) columns, row-major."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity() -> Column:
    return F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])


def matmul(a: Column, b: Column) -> Column:
    """a x b."""
    return F.array(
        *[
            a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c]
            for r in range(3)
            for c in range(3)
        ]
    )


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def scaled(h: Column) -> Column:
    """The same projective map with its last entry 1."""
    return bound(h, lambda m: F.transform(m, lambda v: v / m[8]))


def apply_transform(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Image of (x, y), with the perspective divide; points at infinity go to 0."""
    depth = h[6] * x + h[7] * y + h[8]

    def divided(value):
        return F.when(depth != 0, value / depth).otherwise(F.lit(0.0))

    return divided(h[0] * x + h[1] * y + h[2]), divided(h[3] * x + h[4] * y + h[5])


def squared_error(h: Column, sx: Column, sy: Column, dx: Column, dy: Column) -> Column:
    """Squared distance between the mapped source point and the target point."""
    u, v = apply_transform(h, sx, sy)
    return (u - dx) * (u - dx) + (v - dy) * (v - dy)


def invertible(h: Column) -> Column:
    """Whether a transform is there, finite, and can be turned round (false for null)."""
    det = (
        h[0] * (h[4] * h[8] - h[5] * h[7])
        - h[1] * (h[3] * h[8] - h[5] * h[6])
        + h[2] * (h[3] * h[7] - h[4] * h[6])
    )
    sound = ~F.isnan(det) & (F.abs(det) > 1e-12) & (F.abs(det) < 1e300)
    return h.isNotNull() & F.coalesce(sound, F.lit(False))
