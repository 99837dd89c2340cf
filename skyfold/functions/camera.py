"""Cameras and projections. A camera is a handful of numbers on the driver; what it does to stars and cells is columns."""

from __future__ import annotations

from dataclasses import dataclass
from math import atan, hypot, pi, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[float, float, float]

# Galactic north pole and centre as equatorial unit vectors, before normalization.
GALACTIC_NORTH, GALACTIC_CENTRE = (-0.86703, -0.20006, 0.45673), (-0.05487, -0.87344, -0.48384)


def unit(v: Vec) -> Vec:
    n = hypot(*v)
    if not 0 < n < float("inf"):
        raise ValueError(f"{v} has no direction")
    return tuple(c / n for c in v)


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def galactic_axes() -> tuple[Vec, Vec]:
    """Right and up of a map seen from the galactic north."""
    forward = tuple(-c for c in unit(GALACTIC_NORTH))
    right = unit(cross(forward, GALACTIC_CENTRE))
    return right, unit(cross(right, forward))


@dataclass(frozen=True)
class Camera:
    """fov (degrees, vertical) for perspective, half_width (pc) for an orthographic view; exactly one of them."""

    eye: Vec
    direction: Vec
    upward: Vec
    width: int
    height: int
    fov: float | None = None
    half_width: float | None = None
    near: float = 0.1
    far: float = 5000.0

    def __post_init__(self):
        if (self.fov is None) == (self.half_width is None):
            raise ValueError("give either fov or half_width")

    @property
    def forward(self) -> Vec:
        return unit(self.direction)

    @property
    def right(self) -> Vec:
        return unit(cross(self.forward, self.upward))

    @property
    def up(self) -> Vec:
        return cross(self.right, self.forward)

    @property
    def scale(self) -> tuple[float, float]:
        """Half width and half height of the view: as tangents in perspective, in parsecs otherwise."""
        h = tan(self.fov * pi / 360) if self.fov else self.half_width * self.height / self.width
        return h * self.width / self.height, h

    def planes(self) -> list[tuple[float, float, float, float]]:
        """Six planes (nx, ny, nz, d); a point is in view where n . p + d >= 0 for all."""
        f, r, u, (w, h) = self.forward, self.right, self.up, self.scale
        along = lambda v, k: tuple(e + k * c for e, c in zip(self.eye, v))
        ends = [(along(f, self.near), f), (along(f, self.far), tuple(-c for c in f))]
        for axis, size in ((r, w), (u, h)):
            for sign in (1.0, -1.0):
                if self.fov:  # the sides meet in the eye
                    ends.append((self.eye, unit(tuple(sign * a + size * b for a, b in zip(axis, f)))))
                else:
                    ends.append((along(axis, -sign * size), tuple(sign * a for a in axis)))
        return [(*n, -dot(n, p)) for p, n in ends]

    def sees_point(self, x: Column, y: Column, z: Column) -> Column:
        ok = F.lit(True)
        for nx, ny, nz, d in self.planes():
            ok = ok & (nx * x + ny * y + nz * z + d >= 0)
        return ok

    def sees_box(self, box: dict[str, Column]) -> Column:
        """A box is culled only if its corner farthest along some plane's normal is behind that plane."""
        ok = F.lit(True)
        for nx, ny, nz, d in self.planes():
            x, y, z = (box[a + ("1" if n >= 0 else "0")] for a, n in zip("xyz", (nx, ny, nz)))
            ok = ok & (nx * x + ny * y + nz * z + d >= 0)
        return ok

    def footprint(self, box: dict[str, Column]) -> Column:
        """Pixels that half a cell covers, from its centre's distance (at least that half)."""
        half = (box["x1"] - box["x0"]) / 2
        if self.half_width:
            return half * (self.width / self.half_width)
        delta = [(box[f"{a}0"] + box[f"{a}1"]) / 2 - e for a, e in zip("xyz", self.eye)]
        dist = F.greatest(F.sqrt(dot(delta, delta)), half)
        return half / dist * (self.height / (2 * atan(self.scale[1])))

    def project(self, x: Column, y: Column, z: Column) -> dict[str, Column]:
        """Screen position sx, sy and depth along the view; keep only depth > 0."""
        rel = [c - e for c, e in zip((x, y, z), self.eye)]
        depth, (w, h) = dot(rel, self.forward), self.scale
        by = F.when(depth > 0, depth) if self.fov else F.lit(1.0)
        sx = (dot(rel, self.right) / (by * w) * 0.5 + 0.5) * self.width
        sy = (1 - (dot(rel, self.up) / (by * h) * 0.5 + 0.5)) * self.height
        return {"sx": sx, "sy": sy, "depth": depth, "ref": depth if self.fov else F.lit(float(self.half_width))}


def galactic_view(half: float, width: int, height: int, half_width: float | None = None) -> Camera:
    """The default orthographic view: from the galactic north, the centre up."""
    n = unit(GALACTIC_NORTH)
    return Camera(tuple(2 * half * c for c in n), tuple(-c for c in n), unit(GALACTIC_CENTRE), width, height, half_width=half_width or half, far=4 * half)


def default_exposure(camera: Camera) -> float:
    return camera.half_width**2 / 5000 if camera.half_width else 500.0
