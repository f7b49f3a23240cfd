"""Exact integer rounding, geometry and identity as Column functions. All of them give NULL for NULL arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000


def _col(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body or a lambda in it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, truncated towards zero; NULL for a zero divisor."""
    a, b = _col(a), _col(b)
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def ratio_half_up(n: Column, d: Column) -> Column:
    """n / d for n >= 0, d > 0, halves up."""
    n, d = _col(n), _col(d)
    return div(2 * n + d, 2 * d)


def ratio_ppm(n: Column, d: Column) -> Column:
    """n / d in parts per million, halves up."""
    return ratio_half_up(_col(n) * F.lit(PPM).cast("bigint"), _col(d))


def ratio_half_away(n: Column, d: Column) -> Column:
    """n / d, halves away from zero."""
    n, d = _col(n), _col(d)
    return F.when(n < 0, -div(-2 * n + d, 2 * d)).otherwise(div(2 * n + d, 2 * d))


def round_half_up(x: Column) -> Column:
    """A double to the nearest integer, halves up."""
    return F.floor(_col(x) + 0.5).cast("bigint")


def quantize(x: Column, scale: int = PPM) -> Column:
    return round_half_up(_col(x) * scale)


def lerp(left: Column, right: Column, t_left: Column, t_right: Column, t: Column) -> Column:
    """Linear interpolation inside [t_left, t_right]; NULL outside or without a bracket."""
    left, right, a, b, t = map(_col, (left, right, t_left, t_right, t))
    return F.when((t >= a) & (t <= b) & (b > a), left + (right - left) * ((t - a).cast("double") / (b - a))).when((t == a) & (a == b), left.cast("double"))


def iou_ppm(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two half-open intervals in parts per million, rounded down."""
    a0, a1, b0, b1 = map(_col, (a0, a1, b0, b1))
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    return div(both * F.lit(PPM).cast("bigint"), (a1 - a0) + (b1 - b0) - both)


def grid_times(span_us: Column, num: int = 30, den: int = 1) -> Column:
    """Nominal times of a rate num/den within [0, span], half up, and the exact end: an array without repeats."""
    span = _col(span_us)
    step = F.lit(1_000_000 * den)
    last = div(span * num, step)
    nominal = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: div(2 * i * step + num, F.lit(2 * num)))
    inside = F.filter(nominal, lambda t: t <= span)
    return F.when(F.element_at(inside, -1) == span, inside).otherwise(F.concat(inside, F.array(span)))


def uniform_indices(n: Column, m: int) -> Column:
    """m of n positions, ends included, at round-half-up(i (n-1) / (m-1)); all of them if n <= m."""
    n = _col(n).cast("bigint")
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)))
    picked = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: div(2 * i.cast("bigint") * (n - 1) + (m - 1), F.lit(2 * (m - 1))))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= m, every).otherwise(picked)


def pad(values: Column, m: int, neutral: Column) -> Column:
    """values with neutral elements on the right up to m."""
    values = _col(values)
    return F.concat(values, F.array_repeat(neutral, F.greatest(F.lit(m) - F.size(values), F.lit(0))))


def fixed_length(values: Column, m: int, neutral: Column) -> Column:
    """m values: those at the uniform_indices of the whole sequence, padded if it has fewer."""
    values = _col(values)
    return pad(F.transform(uniform_indices(F.size(values), m), lambda i: F.get(values, i.cast("int"))), m, neutral)


def temperature_softmax(p: Column, temperature: float | Column, floor: float = 1e-12) -> Column:
    """Probabilities sharpened (temperature < 1) or flattened: softmax of their logarithms over the temperature."""
    t = _col(temperature)
    logits = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(floor))) / t)
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _minus(a: Column, b: Column) -> tuple[Column, ...]:
    return tuple(a[c] - b[c] for c in "xyz")


def _length(v: tuple[Column, ...]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at point b between points a and c (x, y, z) in radians; NULL if a side has no length."""
    u, v = _minus(_col(a), _col(b)), _minus(_col(c), _col(b))
    norm = _length(u) * _length(v)
    return F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (u[0] * v[0] + u[1] * v[1] + u[2] * v[2]) / norm))))


def unmirror(points: Column, mirrored: Column, image: bool = True) -> Column:
    """Undoes a mirrored camera: image x becomes 1 - x, world x becomes -x."""
    mirrored = _col(mirrored)
    return F.transform(_col(points), lambda p: p.withField("x", F.when(mirrored, 1 - p["x"] if image else -p["x"]).otherwise(p["x"])))


def centroid(points: Column, indices: tuple[int, ...], axes: str = "xy") -> Column:
    """Mean of selected points along the axes, as a struct."""
    points = _col(points)
    mean = lambda c: sum((F.get(points, F.lit(k))[c] for k in indices), F.lit(0.0)) / len(indices)
    return F.struct(*(mean(c).alias(c) for c in axes))


def hand_local(points: Column, left: Column, mirrored: Column, origin: int = 0, reach: int = 9) -> Column:
    """World points (x, y, z) relative to the origin point, scaled by its distance to the reach point; NULL if that distance is 0.

    The mirror is undone first. A hand is told as left or right as if the camera were mirrored, so it is the other one where it
    wasn't; x of left hands is reflected.
    """
    left, mirrored = _col(left), _col(mirrored)
    turned = F.when(mirrored, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.when(left == mirrored, F.lit(-1.0)).otherwise(F.lit(1.0))

    def local(p: Column) -> Column:
        o = F.get(p, F.lit(origin))
        axes = F.struct(o.alias("o"), _length(_minus(F.get(p, F.lit(reach)), o)).alias("s"), turned.alias("f"))
        each = lambda a: F.transform(p, lambda q: F.struct((a["f"] * (q["x"] - a["o"]["x"]) / a["s"]).alias("x"), ((q["y"] - a["o"]["y"]) / a["s"]).alias("y"), ((q["z"] - a["o"]["z"]) / a["s"]).alias("z")))
        return let(axes, lambda a: F.when(a["s"] > 0, each(a)))

    return let(_col(points), local)


def tip_distances(local: Column, tips: tuple[int, ...] = (4, 8, 12, 16, 20)) -> Column:
    """Distances of the fingertips from the origin of hand-local points."""
    local = _col(local)
    return F.array(*(_length(tuple(F.get(local, F.lit(k))[c] for c in "xyz")) for k in tips))


def body_relative(x: Column, y: Column, left_x: Column, left_y: Column, right_x: Column, right_y: Column) -> Column:
    """A point relative to the shoulders' midpoint in shoulder widths; NULL without shoulders or width."""
    x, y, lx, ly, rx, ry = map(_col, (x, y, left_x, left_y, right_x, right_y))
    width = F.sqrt(F.pow(lx - rx, 2) + F.pow(ly - ry, 2))
    return F.when(width > 0, F.struct(((x - (lx + rx) / 2) / width).alias("x"), ((y - (ly + ry) / 2) / width).alias("y")))


def opaque_id(prefix: str, domain: str, *parts: Column) -> Column:
    """prefix and 32 hex digits of the SHA-256 over domain and length-prefixed parts."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    framed = [F.concat(F.lpad(F.hex(F.octet_length(x)), 8, "0"), F.lit(":"), x) for x in texts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(domain + "|"), *framed), 256), 1, 32))


def row_digest(domain: str, **fields: Column) -> Column:
    """SHA-256 of domain, a bar and the JSON of the named integer or text fields in name order."""
    ordered = F.struct(*(_col(fields[k]).alias(k) for k in sorted(fields)))
    return F.sha2(F.concat(F.lit(domain + "|"), F.to_json(ordered, {"ignoreNullFields": "false"})), 256)


def content_path(digest: Column, name: Column) -> Column:
    """objects/sha256/p-ab/sha256-<digest>/<name>."""
    digest = _col(digest)
    return F.concat_ws("/", F.lit("objects"), F.lit("sha256"), F.concat(F.lit("p-"), F.substring(digest, 1, 2)), F.concat(F.lit("sha256-"), digest), _col(name).cast("string"))


def portable_path(path: Column) -> Column:
    """Whether a path is relative, without drive, empty, `.` or `..` parts, backslashes or control characters."""
    path = _col(path)
    parts = F.split(path, "/", -1)
    return ~path.rlike(r"^([A-Za-z]:|/)|\\|[\x00-\x1f\x7f]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
