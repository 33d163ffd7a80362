"""The nearest earlier event by eta, tile by tile, without a row for each pair.

Two tilings find each event's parent among all earlier events:

* Slabs of time with about as many events each. An event meets all earlier ones of its own slab and of the one before, wherever they lie.
* Cubes of space. What is older than that must lie within a reach that follows from the best eta of the slabs, the age that it has at least, and
  its magnitude: few small events are near enough, and large ones are few. An earlier event goes to the cubes it can reach only. Events whose
  reach is far beyond that of the rest (nothing lies in their slabs) meet all earlier events instead, in parts of a fixed size.

In a tile, earlier events lie in strata of magnitude and, in each, in pyramids of cubes in order of time. The last ones of its cubes give an event a
first bound of eta. Rings around it then look back the less the wider they are, and the innermost to the start; each reads stretches of time of
a few cubes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.params import EARTH_KM, Params
from quakeloom.session import cut

#: Events of a slab at most, of one of few slabs at least, and so few slabs.
SLAB, LEAST_SLAB, FEW_SLABS = 100_000, 4_000, 16
#: Events that ask, of a cube on the mean; cubes at least and at most; larger tiles than so many events that ask or are earlier are split by hash.
CUBE, LEAST_CUBES, MOST_CUBES, TILE_EVENTS = 30_000, 16, 2_000, 500_000
#: So far above the share TIGHT of all, a reach is far beyond the rest.
TIGHT, FAR = 0.999, 4.0
#: Rings around an event end at these radii; each stratum of magnitude has so many times the events of the one above, and is so wide at least.
RADII_KM = tuple(4.0**k for k in range(-3, 8))
STRATA_GROWTH, STRATA_STEP = 4, 0.3
#: Rings that look back over so few events of a stratum, wherever they are, are one with all beyond; last events of a cube that give a first bound; pairs at once.
FEW_ANYWHERE, LAST, PAIRS_AT_ONCE = 16, 2, 500_000
#: Radii in which the nearest event is looked for, each four times the one before.
RECENT_RADII = 6
#: More than the rounding of a value, as a share of it. Unit vectors nearer than CLOSE are told apart by their angles.
SLACK, CLOSE = 1e-8, 1e-6
#: Bits of each axis of the finest cubes.
BITS = 12
_EVENT = ("event_id", "t", "mag", "lat", "lon")
_PARENT = ("p_event_id", "p_t", "p_mag", "p_lat", "p_lon")
#: What a tile answers: pairs, the value (seconds x km ** d_f / 10 ** (b x magnitude)) of the best, and in slabs what is left to look for.
PAIRS = "layer int, event_id long, t long, lat double, lon double, p_event_id long, p_t long, p_mag double, p_lat double, p_lon double, value double"
_TILE = "tile long, part int, role int, event_id long, t long, mag double, lat double, lon double, value double"


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _light(mag: np.ndarray, b: float) -> np.ndarray:
    return np.power(10.0, -b * mag)


def _strata(mag: np.ndarray) -> list[np.ndarray]:
    """Places of the events of each stratum of magnitude, largest first: STRATA_GROWTH times as many in each, at least STRATA_STEP wide."""
    order = np.sort(mag)[::-1]
    edges, rank = [], FEW_ANYWHERE
    while rank < len(order):
        if not edges or edges[-1] - order[rank] >= STRATA_STEP:
            edges.append(order[rank])
        rank *= STRATA_GROWTH
    of = np.searchsorted(-np.array(edges), -mag, side="left")
    return [x for x in (np.flatnonzero(of == s) for s in range(len(edges) + 1)) if len(x)]


class _Level:
    """Events in order of time, by cubes of one width."""

    def __init__(self, at: np.ndarray, t: np.ndarray, km: float):
        self.radius = km / EARTH_KM * (1 + 1e-9)
        self.width = 2 * km / EARTH_KM * (1 + 1e-6)
        keys = self.key(np.floor(at / self.width).astype(np.int64))
        self.order = np.argsort(keys, kind="stable")
        self.keys, rank = np.unique(keys[self.order], return_inverse=True)
        self.start, self.span = t[0], t[-1] - t[0] + 2
        self.places = rank * self.span + (t[self.order] - self.start)

    def key(self, cube: np.ndarray) -> np.ndarray:
        return (cube[:, 0] << 42) + (cube[:, 1] << 21) + cube[:, 2]

    def ranges(self, keys: np.ndarray, since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys have events, and where in `order` those from `since` to before `until` lie."""
        place = np.searchsorted(self.keys, keys)
        there = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == keys)
        base = place[there] * self.span
        first, last = (np.searchsorted(self.places, base + np.clip(x[there] - self.start, 0, self.span - 1)) for x in (since, until))
        return there, first, last

    def around(self, at: np.ndarray, since: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ranges of all cubes that the ball around an event reaches into: two an axis at most."""
        low, high = np.floor((at - self.radius) / self.width).astype(np.int64), np.floor((at + self.radius) / self.width).astype(np.int64)
        for corner in range(8):
            bits = np.array([corner >> i & 1 for i in range(3)], bool)
            new = np.flatnonzero((high > low)[:, bits].all(axis=1))
            there, first, last = self.ranges(self.key(np.where(bits, high[new], low[new])), since[new], until[new])
            yield new[there], first, last


def _spread(compare: Callable[[np.ndarray, np.ndarray], None], one: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """Compare each with its range of `of`, so many pairs at once."""
    ends = np.cumsum(last - first)
    start = 0
    while start < len(one):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        lengths = (last - first)[start:stop]
        if lengths.sum():
            place = np.arange(lengths.sum()) + np.repeat(first[start:stop] - np.cumsum(lengths) + lengths, lengths)
            compare(np.repeat(one[start:stop], lengths), of[place])
        start = stop


def nearest(q: dict, p: dict, d_f: float, b: float, limits: np.ndarray, every: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in `q` and `p` of pairs within SLACK of the least value of an event of `q`, if that isn't above its limit; and the least values.

    q, p: t, lat, lon (radians), p also mag. every: gets all pairs that are compared."""
    best, found = limits * (1 + SLACK), []
    q_at, q_t, p_at, p_t = _unit(q["lat"], q["lon"]), q["t"], _unit(p["lat"], p["lon"]), p["t"]
    light = _light(p["mag"], b)

    def compare(one: np.ndarray, other: np.ndarray) -> None:
        if every is not None:
            every.append((one, other))
        square = np.zeros(len(one))
        for i in range(3):
            square += (q_at[one, i] - p_at[other, i]) ** 2
        close = np.flatnonzero(square < CLOSE * CLOSE)
        if len(close):
            a, c = one[close], other[close]
            up, across = np.sin((p["lat"][c] - q["lat"][a]) / 2), np.sin((p["lon"][c] - q["lon"][a]) / 2)
            square[close] = 4 * (up * up + np.cos(q["lat"][a]) * np.cos(p["lat"][c]) * across * across)
        seconds = (q_t[one] - p_t[other]).astype(np.float64)
        # chords are shorter than arcs: few pairs are left for the arcs
        value = seconds * light[other] * (EARTH_KM * EARTH_KM * square) ** (d_f / 2)
        some = np.flatnonzero((value <= best[one]) & (seconds > 0) & (square > 0))
        one, other = one[some], other[some]
        value = seconds[some] * light[other] * (2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(square[some]) / 2, 1.0))) ** d_f
        np.minimum.at(best, one, value * (1 + SLACK))
        kept = value <= best[one]
        found.append((one[kept], other[kept], value[kept]))

    def spread(*ranges: np.ndarray) -> None:
        _spread(compare, *ranges)

    strata = []
    for of in _strata(p["mag"]):
        of = of[np.argsort(p_t[of], kind="stable")]
        strata.append((of, p_at[of], p_t[of], float(p["mag"][of].max()), {}))

    def level(stratum: tuple, k: int) -> _Level:
        _, at, t, _, levels = stratum
        if k not in levels:
            levels[k] = _Level(at, t, RADII_KM[k])
        return levels[k]

    everyone = np.arange(len(q_t))
    if not np.isfinite(limits).all():
        # a first bound: the last ones of the same cubes, or anywhere
        for stratum in strata:
            of, _, t, _, _ = stratum
            end = np.searchsorted(t, q_t)
            spread(everyone, of, np.maximum(end - LAST, 0), end)
            for k in range(0, len(RADII_KM), 2):
                cubes = level(stratum, k)
                there, first, last = cubes.ranges(cubes.key(np.floor(q_at / cubes.width).astype(np.int64)), np.full(len(q_t), t[0]), q_t)
                spread(there, of[cubes.order], np.maximum(first, last - LAST), last)
    for stratum in strata:
        of, _, t, largest, _ = stratum
        asked = everyone[q_t > t[0]]
        for k, radius in enumerate(RADII_KM):
            if not len(asked):
                break
            whole = (q_t[asked] - t[0]).astype(np.float64)
            reach = best[asked] * 10.0 ** (b * largest)
            look = np.minimum(whole, reach / RADII_KM[k - 1] ** d_f) if k else whole
            # nothing lies as little as a second back; beyond the last radius is nothing
            on = look >= 1
            asked, look, whole, reach = asked[on], np.floor(look[on]).astype(np.int64), whole[on], reach[on]
            end, begin = np.searchsorted(t, q_t[asked]), np.searchsorted(t, q_t[asked] - look)
            inside = reach / radius**d_f >= whole  # the next ring looks back to the start, too
            few = (end - begin <= FEW_ANYWHERE) & ~inside if k + 1 < len(RADII_KM) else np.ones(len(asked), bool)
            spread(asked[few], of, begin[few], end[few])
            ring = ~few & ~inside
            cubes = level(stratum, k)
            mine = asked[ring]
            for some, first, last in cubes.around(q_at[mine], q_t[mine] - look[ring], q_t[mine]):
                spread(mine[some], of[cubes.order], first, last)
            asked = asked[~few]
    one, other, value = (np.concatenate([np.empty(0, np.int64 if k < 2 else np.float64), *(x[k] for x in found)]) for k in range(3))
    kept = value <= best[one]
    pairs = np.unique(np.stack([one[kept], other[kept]], axis=1), axis=0)
    least = np.full(len(q_t), np.inf)
    np.minimum.at(least, one, value)
    return pairs[:, 0], pairs[:, 1], least


def nearest_within(q: dict, p: dict, radius_km: float, window: int, height: float, serving: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in `q` and `p` of the pairs whose distance is the least of an event of `q` up to rounding (one of each place), if that is within the radius.

    q, p: event_id, t, lat, lon (radians), latitude, longitude (degrees, as the box of `height` and of q's half is); p in order of time."""
    best, found = np.full(len(q["t"]), (radius_km / EARTH_KM * (1 + SLACK)) ** 2), []
    q_at, p_at = _unit(q["lat"], q["lon"]), _unit(p["lat"], p["lon"])

    def compare(one: np.ndarray, other: np.ndarray) -> None:
        square = np.zeros(len(one))
        for i in range(3):
            square += (q_at[one, i] - p_at[other, i]) ** 2
        close = np.flatnonzero(square < CLOSE * CLOSE)
        if len(close):
            a, c = one[close], other[close]
            up, across = np.sin((p["lat"][c] - q["lat"][a]) / 2), np.sin((p["lon"][c] - q["lon"][a]) / 2)
            square[close] = 4 * (up * up + np.cos(q["lat"][a]) * np.cos(p["lat"][c]) * across * across)
        some = np.flatnonzero(square <= best[one])
        one, other, square = one[some], other[some], square[some]
        before = p["t"][other] < q["t"][one]
        if not serving:
            before |= (p["t"][other] == q["t"][one]) & (p["event_id"][other] < q["event_id"][one])
        boxed = (np.abs(p["latitude"][other] - q["latitude"][one]) <= height) & (np.abs(p["longitude"][other] - q["longitude"][one]) <= q["half"][one])
        one, other, square = (x[before & boxed] for x in (one, other, square))
        np.minimum.at(best, one, square * (1 + SLACK))
        kept = square <= best[one]
        found.append((one[kept], other[kept], square[kept]))

    asked = np.arange(len(q["t"])) if len(p["t"]) else np.empty(0, np.int64)
    for k in range(RECENT_RADII - 1, -1, -1):
        if not len(asked):
            break
        cubes = _Level(p_at, p["t"], radius_km / 4.0**k)
        for some, first, last in cubes.around(q_at[asked], q["t"][asked] - window, q["t"][asked] + (not serving)):
            _spread(compare, asked[some], cubes.order, first, last)
        asked = asked[best[asked] > cubes.radius**2]
    one, other, square = (np.concatenate([np.empty(0, np.int64 if k < 2 else np.float64), *(x[k] for x in found)]) for k in range(3))
    kept = square <= best[one]
    one, other = one[kept], other[kept]
    # of one place the first in order of time and id
    order = np.lexsort((p["event_id"][other], p["t"][other], p["longitude"][other], p["latitude"][other], one))
    one, other = one[order], other[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (p["latitude"][other[1:]] != p["latitude"][other[:-1]]) | (p["longitude"][other[1:]] != p["longitude"][other[:-1]])
    return one[new], other[new]


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy() for c in names}


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _pairs(layer: int, q: dict, p: dict, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> dict:
    return {
        "layer": np.full(len(i), layer, np.int32), "event_id": q["event_id"][i], "t": q["t"][i], "lat": q["lat"][i], "lon": q["lon"][i],
        **{name: p[c][j] for name, c in zip(_PARENT, _EVENT)}, "value": value[i],
    }


def _above(cutoff: float | None, mag: np.ndarray) -> np.ndarray:
    return np.ones(len(mag), bool) if cutoff is None else mag >= cutoff


def _slab_edges(rows: DataFrame, cutoffs: list[float | None]) -> list[list[int]]:
    """Per cutoff the times at which a slab ends and the next begins."""
    above = [F.lit(True) if c is None else F.col("mag") >= c for c in cutoffs]
    counts = rows.agg(*(F.count_if(a).alias(f"n{i}") for i, a in enumerate(above))).first()
    slabs = [max(2, -(-n // SLAB), min(FEW_SLABS, n // LEAST_SLAB)) for n in counts]
    shares = [F.array(*(F.lit(k / n) for k in range(1, n))) for n in slabs]
    found = rows.agg(*(F.percentile_approx(F.when(a, F.col("t")), s, 10_000).alias(f"e{i}") for i, (a, s) in enumerate(zip(above, shares)))).first()
    return [sorted(set(e or [])) for e in found]


def _compared(every: list, q: dict, p: dict) -> pa.Table:
    i, j = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in every)]) for k in (0, 1))
    return pa.table({"event_id": q["event_id"][i], "p_event_id": p["event_id"][j]})


def in_slabs(rows: DataFrame, cutoffs: list[float | None], p: Params, count: bool = False) -> DataFrame:
    """PAIRS of each event with the best of its slab and the one before (nulls: none), by layer (place in `cutoffs`: events of that magnitude or more
    among each other); first: one row of each; rest: value a second that is left to older ones (null: there are none); cell: its finest cube.

    rows: _EVENT and role (1: is an earlier event, 2: asks, 3: both). count: all pairs that are compared instead."""
    edges = _slab_edges(rows, cutoffs)
    d_f, b = p.d_f, p.b

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch, *_EVENT, "role")
            for layer, cutoff in enumerate(cutoffs):
                slab = np.searchsorted(edges[layer], x["t"], side="right")
                above = _above(cutoff, x["mag"])
                later = above & (x["role"] & 1 > 0) & (slab < len(edges[layer]))
                for of, ahead in ((above, 0), (later, 1)):
                    role = x["role"][of] if not ahead else np.ones(of.sum(), np.int32)
                    yield _batch(tile=layer << 32 | (slab[of] + ahead), part=np.zeros(of.sum(), np.int32), role=role.astype(np.int32), **{c: x[c][of] for c in _EVENT}, value=np.full(of.sum(), np.inf))

    def tile(rows: pa.Table) -> pa.Table:
        x = _columns(rows, "tile", "role", *_EVENT)
        layer, slab = int(x["tile"][0] >> 32), int(x["tile"][0] & (1 << 32) - 1)
        q, past = ({c: x[c][of] for c in _EVENT} for of in (x["role"] & 2 > 0, x["role"] & 1 > 0))
        every = [] if count else None
        i, j, least = nearest(q, past, d_f, b, np.full(len(q["t"]), np.inf), every)
        if count:
            return _compared(every, q, past)
        first = np.zeros(len(i), bool)
        first[np.unique(i, return_index=True)[1]] = True
        since = edges[layer][slab - 2] if slab >= 2 else None
        rest = np.full(len(q["t"]), np.nan) if since is None else least / (q["t"] - since)
        cube = np.clip(np.floor((_unit(q["lat"], q["lon"]) + 1) * 2.0 ** (BITS - 1)).astype(np.int64), 0, (1 << BITS) - 1)
        cell = cube[:, 0] << 2 * BITS | cube[:, 1] << BITS | cube[:, 2]
        told = pa.table(_pairs(layer, q, past, i, j, least) | {"first": first, "rest": pa.array(rest[i], mask=np.isnan(rest[i])), "cell": cell[i]})
        alone = np.flatnonzero(~(least < np.inf))
        n = len(alone)
        nobody = {c: pa.nulls(n, pa.int64() if c in ("p_event_id", "p_t") else pa.float64()) for c in _PARENT}
        lonely = {"layer": np.full(n, layer, np.int32), **{c: q[c][alone] for c in ("event_id", "t", "lat", "lon")}, **nobody, "value": np.full(n, np.inf), "first": np.ones(n, bool), "rest": pa.array(rest[alone], mask=np.isnan(rest[alone])), "cell": cell[alone]}
        return pa.concat_tables([told, pa.table(lonely)])

    dealt = rows.mapInArrow(deal, _TILE)
    return dealt.groupBy("tile").applyInArrow(tile, "event_id long, p_event_id long" if count else f"{PAIRS}, first boolean, rest double, cell long")


@dataclass
class _Cubes:
    """Of a layer: how far its finest cubes are shifted, keys and corners of its cubes, the largest `rest` of each, and the largest that isn't far; parts
    (asking, earlier) of each tile that is split."""

    shift: int
    keys: np.ndarray
    low: np.ndarray
    rest: np.ndarray
    limit: float
    far: bool


def _coarse(cell, shift: int):
    """The key of the cube that holds a finest one; of numbers or columns."""
    if isinstance(cell, np.ndarray):
        axes = [(cell >> k * BITS & (1 << BITS) - 1) >> shift for k in (2, 1, 0)]
        return axes[0] << 2 * BITS | axes[1] << BITS | axes[2]
    axes = [F.shiftright(F.shiftright(cell, k * BITS).bitwiseAND((1 << BITS) - 1), shift) for k in (2, 1, 0)]
    return F.shiftleft(axes[0], 2 * BITS).bitwiseOR(F.shiftleft(axes[1], BITS)).bitwiseOR(axes[2])


def _cubes(asks: DataFrame) -> dict[int, _Cubes]:
    """By layer. Some thousand rows at most reach the driver."""
    shifts = range(BITS)
    told = asks.groupBy("layer").agg(
        F.count("*").alias("n"), F.percentile_approx(F.when(F.col("rest") < float("inf"), F.col("rest")), TIGHT, 1_000).alias("tight"), F.max("rest").alias("most"),
        *(F.approx_count_distinct(_coarse(F.col("cell"), s)).alias(f"c{s}") for s in shifts),
    ).collect()
    chosen = {}
    for r in told:
        asked = min(MOST_CUBES, max(LEAST_CUBES, r.n // CUBE))
        fitting = [s for s in shifts if r[f"c{s}"] <= 4 * asked]
        enough = [s for s in fitting if r[f"c{s}"] >= asked]
        chosen[r.layer] = (max(enough) if enough else min(fitting, default=BITS - 1), FAR * r.tight if r.tight is not None else 0.0, r.most)
    if not chosen:
        return {}
    key = F.coalesce(*(F.when(F.col("layer") == layer, _coarse(F.col("cell"), s)) for layer, (s, _, _) in chosen.items()))
    limit = F.coalesce(*(F.when(F.col("layer") == layer, F.lit(limit)) for layer, (_, limit, _) in chosen.items()))
    cubes = asks.where(F.col("rest") <= limit).groupBy("layer", key.alias("key")).agg(F.max("rest").alias("rest")).collect()
    out = {}
    for layer, (s, limit, most) in chosen.items():
        keys, rest = (np.array([r[c] for r in cubes if r.layer == layer], dtype=t) for c, t in (("key", np.int64), ("rest", np.float64)))
        axes = np.stack([keys >> k * BITS & (1 << BITS) - 1 for k in (2, 1, 0)], axis=1)
        out[layer] = _Cubes(s, keys, (axes << s) * 2.0 ** (1 - BITS) - 1, rest, limit, most > limit)
    return out


def _reached(cubes: _Cubes, at: np.ndarray, mag: np.ndarray, d_f: float, b: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each cube's key and the places of the earlier events that can reach it."""
    width = 2.0 ** (1 - BITS + cubes.shift)
    strength = np.power(10.0, b * mag / d_f) / EARTH_KM
    for key, low, rest in zip(cubes.keys, cubes.low, cubes.rest):
        far = strength * (rest ** (1 / d_f) * (1 + SLACK)) + 1e-12
        square = np.zeros(len(mag))
        for i in range(3):
            square += np.maximum(np.maximum(low[i] - at[:, i], at[:, i] - low[i] - width), 0.0) ** 2
        yield int(key), np.flatnonzero(square <= far * far)


def in_cubes(rows: DataFrame, slabs: DataFrame, cutoffs: list[float | None], p: Params, count: bool = False) -> DataFrame | None:
    """PAIRS of events with older ones that are at least as good as the best of the slabs; None if there is nothing older.

    rows: earlier events as in in_slabs. slabs: its result, written."""
    asks = slabs.where("first AND rest IS NOT NULL")
    layers = _cubes(asks)
    if not layers:
        return None
    d_f, b = p.d_f, p.b
    tile_of = lambda layer, key: layer << 40 | key
    everywhere = lambda layer: layer << 40 | (1 << 3 * BITS)

    def tiles(x: dict, asking: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Tiles and the places in `x` of the events that go there."""
        for layer, cubes in layers.items():
            if asking:
                mine = x["layer"] == layer
                near = np.flatnonzero(mine & (x["rest"] <= cubes.limit))
                keys, back = np.unique(_coarse(x["cell"][near], cubes.shift), return_inverse=True)
                yield from ((tile_of(layer, int(k)), near[back == i]) for i, k in enumerate(keys))
                yield everywhere(layer), np.flatnonzero(mine & ~(x["rest"] <= cubes.limit))
                continue
            some = np.flatnonzero(_above(cutoffs[layer], x["mag"]))
            yield from ((tile_of(layer, k), some[of]) for k, of in _reached(cubes, _unit(x["lat"][some], x["lon"][some]), x["mag"][some], d_f, b))
            if cubes.far:
                yield everywhere(layer), some

    def sizes(asking: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = [(tile, len(of)) for tile, of in tiles(_columns(batch, *batch.schema.names), asking)]
                yield _batch(tile=np.array([t for t, _ in n], np.int64), n=np.array([m for _, m in n], np.int64))

        return run

    past = rows.where("role % 2 = 1").select(*_EVENT)
    asks = asks.select("layer", "event_id", "t", "lat", "lon", "value", "rest", "cell")
    # tiles are some thousands at most
    counted = [{r.tile: -(-r.n // TILE_EVENTS) for r in df.mapInArrow(sizes(asking), "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).where("n > 0").collect()} for df, asking in ((asks, True), (past, False))]

    def deal(asking: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        own, other = counted if asking else counted[::-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _columns(batch, *batch.schema.names)
                spread = x["event_id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for tile, of in tiles(x, asking):
                    if not len(of) or tile not in other:
                        continue
                    mine = (spread[of] % np.uint64(own[tile])).astype(np.int32)
                    for more in range(other[tile]):
                        part = mine * other[tile] + more if asking else more * own[tile] + mine
                        bare = np.zeros(len(of))
                        yield _batch(tile=np.full(len(of), tile, np.int64), part=part.astype(np.int32), role=np.full(len(of), 2 if asking else 1, np.int32),
                                     **{c: x[c][of] if c in x else bare for c in (*_EVENT, "value")})

        return run

    def tile(rows: pa.Table) -> pa.Table:
        x = _columns(rows, "tile", "role", *_EVENT, "value")
        asking = x["role"] == 2
        q, past = ({c: x[c][of] for c in (*_EVENT, "value")} for of in (asking, ~asking))
        every = [] if count else None
        i, j, least = nearest(q, past, d_f, b, q["value"], every)
        return _compared(every, q, past) if count else pa.table(_pairs(int(x["tile"][0] >> 40), q, past, i, j, least))

    dealt = asks.mapInArrow(deal(True), _TILE).unionByName(past.mapInArrow(deal(False), _TILE))
    return dealt.groupBy("tile", "part").applyInArrow(tile, "event_id long, p_event_id long" if count else PAIRS)


def search(rows: DataFrame, cutoffs: list[float | None], p: Params) -> list[DataFrame]:
    """PAIRS that hold each event's best by layer, from slabs and then from cubes. rows: as in in_slabs, a written table."""
    slabs = cut(in_slabs(rows, cutoffs, p))
    older = in_cubes(rows, slabs, cutoffs, p)
    found = slabs.where("p_event_id IS NOT NULL").select(*(c.split()[0] for c in PAIRS.split(", ")))
    return [found, found.limit(0) if older is None else older]


def compared(rows: DataFrame, cutoffs: list[float | None], p: Params) -> DataFrame:
    """event_id and p_event_id of all pairs that `search` compares."""
    found, older = in_slabs(rows, cutoffs, p, count=True), in_cubes(rows, cut(in_slabs(rows, cutoffs, p)), cutoffs, p, count=True)
    return found if older is None else found.unionByName(older)
