"""Column expressions: rounding, scores, labels, strings and plane geometry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linecrest.params import Detection

DETECTION = Detection()


def number(c: Column) -> Column:
    """A double, or null for what is no finite number."""
    d = c.try_cast("double")
    return F.when(F.isnotnull(d) & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def voxel(c: Column) -> Column:
    """Half to even, as a whole number."""
    return F.rint(c).cast("int")


def linear_key(x: Column, y: Column, z: Column, gx: int, gy: int) -> Column:
    return (z.cast("long") * gy + y) * gx + x


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """c within low and high; null stays null, which greatest and least alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    powers = [F.exp(c - top) for c in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def fused_scores(semantic: list[Column], pole: Column, line: Column, objectness: Column, p: Detection = DETECTION) -> tuple[Column, Column]:
    """Pole and line scores from the logits of the semantic, binary and objectness heads."""
    share = softmax(semantic)
    both = p.object_weight * sigmoid(objectness)
    return tuple(clamp(p.semantic_weight * share[i] + p.binary_weight * sigmoid(head) + both) for i, head in ((1, pole), (2, line)))


def label_of(pole: Column, line: Column, pole_threshold, line_threshold) -> Column:
    """1 pole, 2 line, 0 other; if both pass the larger wins, and a tie is a pole."""
    is_pole, is_line = pole >= pole_threshold, line >= line_threshold
    return F.when(is_pole & (~is_line | (pole >= line)), 1).when(is_line, 2).otherwise(0)


def valid_label(c: Column) -> Column:
    """Labels are 0, 1 and 2; anything else is -100, which no metric counts."""
    return F.coalesce(F.when(c.isin(0, 1, 2), c.cast("int")), F.lit(-100))


def safe_id(c: Column) -> Column:
    """A name for files: everything but letters, digits, dot, dash and underscore becomes two underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "__")


def without_csv(c: Column) -> Column:
    return F.regexp_replace(c, r"\.csv(\.gz)?$", "")


def whole_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(-?\d+)")), lambda x: x.cast("long"))


# --- plane geometry ---------------------------------------------------------------------------------------------------


def dot(a: Iterable[Column], b: Iterable[Column]) -> Column:
    terms = [x * y for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: list[Column]) -> list[Column]:
    """A vector of length 1; what is shorter than 1e-9 points along x."""
    n = norm(a)
    return [F.when(n < 1e-9, F.lit(1.0 if i == 0 else 0.0)).otherwise(c / n) for i, c in enumerate(a)]


def angle_deg(a: list[Column], b: list[Column], undirected: bool = False) -> Column:
    """The angle of two directions in degrees; undirected: 90 at most."""
    cosine = dot(unit(a), unit(b))
    cosine = F.abs(cosine) if undirected else cosine
    return F.degrees(F.acos(clamp(cosine, -1.0, 1.0)))


def orient2d(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def rays_meet(p1: list[Column], d1: list[Column], p2: list[Column], d2: list[Column]) -> tuple[Column, Column]:
    """How far along each ray (in units of its direction) the lines cross; null if they are parallel."""
    det = d1[0] * d2[1] - d1[1] * d2[0]
    across = [p2[0] - p1[0], p2[1] - p1[1]]
    solid = F.when(F.abs(det) >= 1e-9, det)
    return (across[0] * d2[1] - across[1] * d2[0]) / solid, (across[0] * d1[1] - across[1] * d1[0]) / solid
