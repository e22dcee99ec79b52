"""Column functions of space, direction, time and colour."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Axis3 = tuple[Column, Column, Column]


def at(vector: str | Column, i: int) -> Column:
    """0-based element, null out of range."""
    return F.get(F.col(vector) if isinstance(vector, str) else vector, i)


def xyz(vector: str) -> Axis3:
    return at(vector, 0), at(vector, 1), at(vector, 2)


def voxel(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def voxel_centre(index: Column, size: float) -> Column:
    return (index + 0.5) * F.lit(float(size))


def screen_cell(value: Column, bins: int) -> Column:
    """A value of exactly 1 falls in cell `bins`."""
    return F.floor(value * bins)


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def azimuth_bin(x: Column, z: Column, bins: int) -> Column:
    return F.floor((F.atan2(z, x) + F.pi()) / (F.pi() * 2) * bins)


def elevation_bin(x: Column, y: Column, z: Column, bins: int) -> Column:
    return F.floor((F.asin(y / F.greatest(norm(x, y, z), F.lit(1e-6))) + F.pi() / 2) / F.pi() * bins)


def bin_direction(azimuth: Column, elevation: Column, bins: int) -> Axis3:
    """Unit direction at the centre of a bin."""
    a = (azimuth + 0.5) / bins * F.pi() * 2 - F.pi()
    e = (elevation + 0.5) / bins * F.pi() - F.pi() / 2
    return F.cos(e) * F.cos(a), F.sin(e), F.cos(e) * F.sin(a)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket, in milliseconds."""
    return F.floor(epoch_ms(ts) / (seconds * 1000)) * (seconds * 1000)


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def json_text(payload: str, *path: str) -> Column:
    return F.get_json_object(payload, "$." + ".".join(path))


def json_int(payload: str, *path: str) -> Column:
    return json_text(payload, *path).try_cast("bigint")


def reported(value: str) -> Column:
    """0 means that the client did not report it."""
    return F.nullif(F.col(value), F.lit(0.0))


def unproject(position: Axis3, direction: Axis3, screen: tuple[Column, Column], fov: Column, aspect: Column, near: Column) -> Axis3:
    """World point of a screen position on the near plane; right and up follow from the view direction."""
    (px, py, pz), (dx, dy, dz), (sx, sy) = position, direction, screen
    length, flat = norm(dx, dy, dz), F.sqrt(dx * dx + dz * dz)
    right = (sx * 2 - 1) * near * F.tan(fov / 2) * aspect
    up = (F.lit(1) - sy * 2) * near * F.tan(fov / 2)
    x = px + dx * near / length + dz / flat * right - dx * dy / (length * flat) * up
    y = py + dy * near / length + flat / length * up
    z = pz + dz * near / length - dx / flat * right - dy * dz / (length * flat) * up
    return x, y, z


def can_unproject(direction: Axis3, fov: Column, aspect: Column, near: Column) -> Column:
    dx, dy, dz = direction
    return (fov > 0) & (aspect > 0) & (near > 0) & (F.sqrt(dx * dx + dz * dz) > norm(dx, dy, dz) * 1e-6)


def _flip(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(-x)


def to_left_handed(vector: Column) -> Column:
    """Right-handed position or direction in the left-handed frame: z negated, no negative zero."""
    return F.when(F.size(vector) == 3, F.array(F.get(vector, 0), F.get(vector, 1), _flip(F.get(vector, 2)))).otherwise(vector)


def box_to_left_handed(box: Column) -> Column:
    """min xyz, max xyz: the z bounds are negated and change places."""
    e = [F.get(box, i) for i in range(6)]
    return F.array(e[0], e[1], _flip(e[5]), e[3], e[4], _flip(e[2]))


def quaternion_to_left_handed(q: Column) -> Column:
    e = [F.get(q, i) for i in range(4)]
    return F.array(_flip(e[0]), _flip(e[1]), e[2], e[3])


def xr_source(target_ray_mode: Column, has_hand: Column) -> Column:
    """Input source of an XR controller: hand tracking first, then what its ray follows."""
    return F.when(has_hand, "hand").when(target_ray_mode == "gaze", "gaze").when(target_ray_mode.isin("transient-pointer", "screen"), "transient").otherwise("xr-controller")


def xr_handedness(value: Column) -> Column:
    return F.when(value.isin("left", "right"), value)


def ramp(t: Column, stops: list[tuple[float, tuple[float, float, float]]]) -> Axis3:
    """Piecewise linear colour of t, clamped to [0, 1]."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))

    def channel(c: int) -> Column:
        out = F.lit(float(stops[-1][1][c]))
        for (t0, a), (t1, b) in reversed(list(zip(stops, stops[1:]))):
            out = F.when(t <= t1, (t - t0) / (t1 - t0) * (b[c] - a[c]) + a[c]).otherwise(out)
        return out

    return channel(0), channel(1), channel(2)
