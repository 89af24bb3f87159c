"""Gates: geometric and Boolean predicates as Columns.

A gate is evaluated on finite rows; its complement is taken after that filter, so that it
holds the rows that are not finite too; then its parent is required.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F

from eventmill.functions.columns import is_finite

#: Edges up to which a polygon is written out as one expression, which code generation likes best.
WRITTEN_OUT = 48


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs)


def interval(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """low <= c < high, either end open."""
    parts = [is_finite(c)]
    if low is not None:
        parts.append(c >= low)
    if high is not None:
        parts.append(c < high)
    return _all(parts)


def box(limits: list[tuple[Column, float | None, float | None]]) -> Column:
    """Rectangle or hyperrectangle, half-open on every axis."""
    return _all([interval(*x) for x in limits])


def viewport(limits: list[tuple[Column, float, float]]) -> Column:
    """What a view shows: closed on every side."""
    return _all([is_finite(c) & c.between(low, high) for c, low, high in limits])


def _upward(vertices: list[tuple[float, float]]) -> list[dict[str, float]]:
    """The sides of a ring by their lower and upper end, with the greatest offset that still counts as on the side."""
    sides = []
    for (ax, ay), (bx, by) in zip(vertices, [*vertices[1:], vertices[0]]):
        (lx, ly), (ux, uy) = sorted([(ax, ay), (bx, by)], key=lambda p: (p[1], p[0]))
        run, rise = ux - lx, uy - ly
        slack = 1e-10 * max(1.0, abs(run), rise)  # a fixed value
        sides.append({"lx": lx, "ly": ly, "uy": uy, "west": min(lx, ux), "east": max(lx, ux), "run": run, "rise": rise, "lean": run / rise if rise else 0.0, "slack": slack})
    return sides


def polygon(x: Column, y: Column, vertices: list[tuple[float, float]], written_out: int = WRITTEN_OUT) -> Column:
    """Even-odd rule, the boundary included.

    A point is inside if a ray to the right meets an odd number of sides, each of which owns
    its lower end and not its upper one. It is on a side if it lies off its line and beyond
    its ends by no more than the side's slack. The bounding box comes first and can be pushed down.
    """
    sides = _upward([(float(a), float(b)) for a, b in vertices])

    def meets(e) -> Column:
        return (y >= e["ly"]) & (y < e["uy"]) & (x - e["lx"] < (y - e["ly"]) * e["lean"])

    def on(e) -> Column:
        off = (y - e["ly"]) * e["run"] - (x - e["lx"]) * e["rise"]
        return (F.abs(off) <= e["slack"]) & x.between(e["west"] - e["slack"], e["east"] + e["slack"]) & y.between(e["ly"] - e["slack"], e["uy"] + e["slack"])

    if len(sides) <= written_out:
        crossings = reduce(lambda a, b: a + b, [meets(e).cast("int") for e in sides if e["rise"]], F.lit(0))
        edge = reduce(lambda a, b: a | b, map(on, sides))
    else:
        ring = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in e.items()]) for e in sides])
        crossings = F.aggregate(ring, F.lit(0), lambda n, e: n + meets(e).cast("int"))
        edge = F.exists(ring, on)
    slack = max(e["slack"] for e in sides)
    xs, ys = zip(*vertices)
    near = x.between(min(xs) - slack, max(xs) + slack) & y.between(min(ys) - slack, max(ys) + slack)
    return is_finite(x) & is_finite(y) & near & ((crossings % 2 == 1) | edge)


def polygon_with_holes(x: Column, y: Column, outer: list[tuple[float, float]], holes: list[list[tuple[float, float]]]) -> Column:
    # many sides in one expression stay small as arrays
    written_out = WRITTEN_OUT if len(outer) + sum(map(len, holes)) <= WRITTEN_OUT else 0
    return reduce(lambda a, h: a & ~polygon(x, y, h, written_out), holes, polygon(x, y, outer, written_out))


def ellipse(x: Column, y: Column, center: tuple[float, float], radii: tuple[float, float], angle: float = 0.0) -> Column:
    c, s = math.cos(angle), math.sin(angle)
    dx, dy = x - center[0], y - center[1]
    return is_finite(x) & is_finite(y) & (F.pow((dx * c + dy * s) / radii[0], F.lit(2.0)) + F.pow((dy * c - dx * s) / radii[1], F.lit(2.0)) <= 1.0)


def ellipsoid(columns: list[Column], mean: list[float], covariance: np.ndarray, square: float) -> Column:
    """(v - mean)' C^-1 (v - mean) <= square."""
    inverse = np.linalg.inv(np.asarray(covariance, float))
    d = [c - float(m) for c, m in zip(columns, mean)]
    form = reduce(lambda a, b: a + b, [a * b * float(inverse[i, j]) for i, a in enumerate(d) for j, b in enumerate(d)])
    return _all([is_finite(c) for c in columns]) & (form <= square)


def quadrant(x: Column, y: Column, center: tuple[float, float], number: int) -> Column:
    """1 left upper, 2 right upper, 3 right lower, 4 left lower; thresholds belong to right and upper."""
    right, upper = x >= center[0], y >= center[1]
    of = {1: ~right & upper, 2: right & upper, 3: right & ~upper, 4: ~right & ~upper}
    return is_finite(x) & is_finite(y) & of[number]


#: Labels of the four sectors counter-clockwise from the first arm, and of the arms themselves.
SECTORS, ARM_OWNERS, CENTRE_OWNER = (2, 1, 4, 3), (2, 2, 1, 3), 2
QUARTERS = (0.0, math.pi / 2, math.pi, 3 * math.pi / 2)


def _arm(angle: float) -> tuple[float, float]:
    """Cosine and sine, exact for the four cardinal directions."""
    if angle in QUARTERS:
        return ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[QUARTERS.index(angle)]
    return math.cos(angle), math.sin(angle)


def _turn(dx, dy, size, when):
    """How far a direction is turned from the first axis, 0 to 4: it grows with the angle, and is whole for cardinal ones."""
    part = dy / size
    return when((dx >= 0) & (dy >= 0), part, when(dx < 0, 2.0 - part, 4.0 + part))


def spider_label(x: Column, y: Column, center: tuple[float, float], scale: tuple[float, float] = (1.0, 1.0), angles: tuple[float, ...] = QUARTERS) -> Column:
    """The sector of a point between four arms from a centre, by angles in radians on axes of ``scale``; NULL if not finite.

    Each point has one label: an arm and the centre belong to a stated sector. The sector is the rank of the point's
    direction among the arms, counted counter-clockwise from the first.
    """
    dx, dy = (x - center[0]) / scale[0], (y - center[1]) / scale[1]
    plain = lambda condition, a, b: a if condition else b
    arms = [_turn(c, s, abs(c) + abs(s), plain) for c, s in map(_arm, angles)]
    own = _turn(dx, dy, F.nullif(F.abs(dx) + F.abs(dy), F.lit(0.0)), lambda condition, a, b: F.when(condition, a).otherwise(b))
    past = F.pmod(own - arms[0], F.lit(4.0))
    ahead = [(a - arms[0]) % 4.0 for a in arms]
    label = F.when((dx == 0) & (dy == 0), CENTRE_OWNER)
    for k in reversed(range(4)):
        label = label.when(own == arms[k], ARM_OWNERS[k]).when(past >= ahead[k], SECTORS[k])
    return F.when(is_finite(x) & is_finite(y), label)


def curly_label(x: Column, y: Column, center: tuple[float, float], coefficients: tuple[float, float] = (1.0, 1.0), scaled: tuple[Column, ...] = ()) -> Column:
    """Quadrants, numbered as in ``quadrant``, whose thresholds rise with the root of the other intensity; NULL if not finite.

    ``coefficients``, not negative, are of the threshold of x and of y. ``scaled`` are the axes as displayed, which must be finite too.
    """
    if min(coefficients) < 0:
        raise ValueError("thresholds rise: their coefficients are not negative")

    def reaches(v: Column, at: float, k: float, other: Column, other_at: float) -> Column:
        """v - at >= k (sqrt(other) - sqrt(base)), with the root of ``other`` alone on its side and both sides squared."""
        base = max(other_at, 0.0)
        left = (v - at) + k * math.sqrt(base)
        return F.when(other <= base, v >= at).otherwise((left >= 0) & (left * left >= k * k * other))

    right = reaches(x, center[0], coefficients[0], y, center[1])
    upper = reaches(y, center[1], coefficients[1], x, center[0])
    label = F.when(~right & upper, 1).when(right & upper, 2).when(right, 3).otherwise(4)
    return F.when(_all([is_finite(c) for c in (x, y, *scaled)]), label)


#: Bits of an event's quality flags.
FLAGS = {"nonfinite": 1, "time": 2, "saturation": 4, "pulse": 8}
OUTSIDE = 16


def quality_gate(flags: Column, bin_id: Column, exclusions: tuple[str, ...] = (), excluded_bins: tuple[int, ...] = (), keep: bool = True) -> Column:
    """Events of the reviewed source population that a quality review keeps, or those that it rejects."""
    bits = sum(FLAGS[name] for name in exclusions)
    rejected = (flags.bitwiseAND(F.lit(bits)) != 0) | (bin_id.isin(*excluded_bins) if excluded_bins else F.lit(False))
    return (flags.bitwiseAND(F.lit(OUTSIDE)) == 0) & (~rejected if keep else rejected)


def quality_population(name: str, flags: Column, bin_id: Column, parent: str | None = None, **review) -> Gate:
    """``quality_gate`` as a population; it belongs to its acquisition and is not copied to other samples."""
    return Gate(name, quality_gate(flags, bin_id, **review), parent, acquisition_bound=True)


def control_selection(gate: Column, detector: Column, low: float | None, high: float | None, detectors: list[Column]) -> Column:
    """A control's events: in the gate, within raw limits of its detector, and finite in all detectors."""
    return gate & interval(detector, low, high) & _all([is_finite(d) for d in detectors])


def time_range(t: Column, start: float, end: float, domain: tuple[float, float] | None = None) -> Column:
    """start <= t < end inside the domain; the domain's own end is included, so that adjacent ranges part it."""
    inside = is_finite(t) & (t >= start) & (t <= end if domain and end >= domain[1] else t < end)
    return inside & t.between(*domain) if domain else inside


def responder(signal: Column, threshold: float) -> Column:
    return is_finite(signal) & (signal > threshold)


def text_filter(needle: str, *parts: Column) -> Column:
    """Whether the parts, joined by spaces, hold the text, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(F.lit(needle)))


@dataclass(frozen=True)
class Gate:
    """A named population: ``test`` on finite rows, below ``parent``."""

    name: str
    test: Column | None = None  # None: all rows of the parent
    parent: str | None = None
    complement: bool = False
    operands: tuple[str, ...] = field(default=())
    op: str = "and"  # of operands: and, or, xor, not
    operand_complements: tuple[bool, ...] = field(default=())
    acquisition_bound: bool = False  # holds event or bin numbers of one acquisition


def linked_family(name: str, axes: list[tuple[Column, float]], parent: str | None = None) -> list[Gate]:
    """The 2 members of a bisector or the 4 of a quadrant: one threshold an axis, together all finite rows of the parent.

    Quadrants are numbered as in ``quadrant``.
    """
    if len(axes) == 1:
        (c, at), = axes
        return [Gate(f"{name} −", interval(c, None, at), parent), Gate(f"{name} +", interval(c, at), parent)]
    (x, cx), (y, cy) = axes
    sides = {1: (False, True), 2: (True, True), 3: (True, False), 4: (False, False)}

    def side(c: Column, at: float, high: bool) -> tuple[Column, float | None, float | None]:
        return (c, at, None) if high else (c, None, at)

    return [Gate(f"{name} Q{k}", box([side(x, cx, right), side(y, cy, upper)]), parent) for k, (right, upper) in sides.items()]


def masks(gates: list[Gate]) -> dict[str, Column]:
    """The mask of every gate with all of its ancestors."""
    by, done, path = {g.name: g for g in gates}, {}, []

    def of(name: str) -> Column:
        if name in done:
            return done[name]
        if name in path:
            raise ValueError(f"gates hold each other: {name}")
        path.append(name)
        g = by[name]
        if g.operands:
            turned = g.operand_complements or (False,) * len(g.operands)
            parts = [~of(o) if c else of(o) for o, c in zip(g.operands, turned, strict=True)]
            own = {"and": lambda: reduce(lambda a, b: a & b, parts), "or": lambda: reduce(lambda a, b: a | b, parts), "xor": lambda: reduce(lambda a, b: a != b, parts), "not": lambda: ~parts[0]}[g.op]()
        else:
            own = F.lit(True) if g.test is None else F.coalesce(g.test, F.lit(False))
        own = ~own if g.complement else own
        done[name] = own & of(g.parent) if g.parent else own
        path.pop()
        return done[name]

    for g in gates:
        of(g.name)
    return done


def paths(gates: list[Gate]) -> dict[str, tuple[str, ...]]:
    """Each gate's names from the root, by which populations of samples are mapped."""
    by = {g.name: g for g in gates}

    def of(g: Gate) -> tuple[str, ...]:
        return (*of(by[g.parent]), g.name) if g.parent else (g.name,)

    return {g.name: of(g) for g in gates}


def _bound(gates: list[Gate]) -> list[str]:
    return [g.name for g in gates if g.acquisition_bound]


def mapped_tree(gates: list[Gate], own: list[Gate], replace_existing: bool = False) -> list[Gate]:
    """``own`` with the populations of ``gates`` copied into it by path.

    A population of the same path stays, or gives way where it is to be replaced; so a copied child hangs below the population that has
    its parent's path here. A copied gate whose name another path has here gets a new one; parents and operands follow.
    """
    if names := _bound(gates):
        raise ValueError(f"these belong to one acquisition: {names}")
    there, mine = paths(own), paths(gates)
    at = {path: name for name, path in there.items()}
    kept = [g for g in own if not (replace_existing and there[g.name] in set(mine.values()))]
    taken, renamed = {g.name for g in own}, {}
    for g in gates:
        here = at.get(mine[g.name])
        if here is not None:
            renamed[g.name] = here
            continue
        name, k = g.name, 2
        while name in taken:
            name, k = f"{g.name} ({k})", k + 1
        taken.add(name)
        renamed[g.name] = name
    copies = [
        replace(g, name=renamed[g.name], parent=renamed[g.parent] if g.parent else None, operands=tuple(renamed[o] for o in g.operands))
        for g in gates
        if replace_existing or mine[g.name] not in at
    ]
    return [*kept, *copies]


def propagated(gates: list[Gate], targets: dict[str, list[Gate]], replace_existing: bool = False) -> dict[str, list[Gate]]:
    """The tree copied to other samples' trees, see ``mapped_tree``; gates that belong to one acquisition are refused."""
    return {sample: mapped_tree(gates, own, replace_existing) for sample, own in targets.items()}
