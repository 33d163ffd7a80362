"""Counts, largest magnitudes and sums within discs and past windows, without a row for each pair.

Events are dealt into tiles several radii wide and several windows long; each tile gets the earlier events that its own can reach.
In a tile, the events that ask are halved again and again in space. What lies in the same ring of radii for all of a half is
summed by contiguous stretches of time, what no one of it can reach is dropped, and only what is left at the edges goes on. Once
few pairs are left they are held against each other one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from quakeloom.operators.range_join import scale
from quakeloom.params import DEGREE_KM, EARTH_KM

#: Tiles are so many radii wide and so many windows long. Denser ones than this many earlier events are split by hash.
TILE_RADII, TILE_WINDOWS, TILE_EVENTS = 3, 8, 1_000_000
#: Pairs at the edges that aren't halved any more, and pairs that are made at once.
FEW_PAIRS, PAIRS_AT_ONCE = 200_000, 40_000
#: More than the rounding of a distance between unit vectors, and of a difference in degrees.
SLACK = 1e-12
_TILE = ("_row", "_cell", "_bucket")


def energy(magnitude: np.ndarray) -> np.ndarray:
    return np.power(10.0, 1.5 * magnitude)


def known(magnitude: np.ndarray) -> np.ndarray:
    return (magnitude > -np.inf) | np.isnan(magnitude)


def known_magnitude(magnitude: np.ndarray) -> np.ndarray:
    return np.where(known(magnitude), magnitude, 0.0)


def _tiles(queries: DataFrame, history: DataFrame, radius_km: float, window_seconds: int, tile_windows: int = TILE_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Query events with their own tile, and earlier events with every tile that holds events which can reach them."""
    half = radius_km / DEGREE_KM
    height, length = TILE_RADII * half, tile_windows * window_seconds

    def reach(row: Column) -> Column:
        """Half of the widest search box in this row, in degrees of longitude."""
        far = F.least(F.greatest(F.abs(row * height), F.abs((row + 1) * height)), F.lit(90.0))
        return F.lit(half * (1 + 1e-9)) / scale(far)

    asked = queries.where(~F.isnan("latitude") & ~F.isnan("longitude")).withColumns({"_row": F.floor(F.col("latitude") / height), "_bucket": F.floor(F.col("sort_time") / length)})
    asked = asked.withColumn("_cell", F.floor(F.col("longitude") / (TILE_RADII * reach(F.col("_row")))))
    past = history.where(~F.isnan("latitude") & ~F.isnan("longitude"))
    rows = F.sequence(F.floor((F.col("latitude") - half * (1 + 1e-9)) / height), F.floor((F.col("latitude") + half * (1 + 1e-9)) / height))
    past = past.withColumn("_row", F.explode(rows))
    width = TILE_RADII * reach(F.col("_row"))
    cells = F.sequence(F.floor((F.col("longitude") - reach(F.col("_row"))) / width), F.floor((F.col("longitude") + reach(F.col("_row"))) / width))
    past = past.withColumn("_cell", F.explode(cells))
    return asked, past.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("sort_time") / length), F.floor((F.col("sort_time") + window_seconds) / length))))


def in_tiles(queries: DataFrame, history: DataFrame, radius_km: float, window_seconds: int, magnitude: Column, tile_windows: int = TILE_WINDOWS) -> GroupedData:
    """By tile the query events (half: of their search box in longitude) and the earlier ones that they can reach (half: -1, and `magnitude`)."""
    asked, past = _tiles(queries, history, radius_km, window_seconds, tile_windows)
    # only tiles that hold asking events, so that a few of them don't shuffle all the history
    past = past.join(F.broadcast(asked.select(*_TILE).distinct()), [*_TILE], "left_semi")
    parts = F.broadcast(past.groupBy(*_TILE).agg(F.ceil(F.count("*") / TILE_EVENTS).cast("int").alias("_parts")))
    mine, each = F.pmod(F.xxhash64("event_id"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    half = F.lit(radius_km / DEGREE_KM) / scale(F.col("latitude"))
    columns = ("event_id", "sort_time", "latitude", "longitude")
    asked = asked.join(parts, [*_TILE]).withColumns({"_asked": mine}).withColumn("_past", each).select(*_TILE, "_asked", "_past", *columns, half.alias("half"), F.lit(0.0).alias("magnitude"))
    past = past.join(parts, [*_TILE]).withColumns({"_past": mine}).withColumn("_asked", each).select(*_TILE, "_asked", "_past", *columns, F.lit(-1.0).alias("half"), magnitude.alias("magnitude"))
    return asked.unionByName(past).groupBy(*_TILE, "_asked", "_past")


def near_sums(
    queries: DataFrame,
    history: DataFrame,
    radii_km: tuple[int, ...],
    windows_seconds: tuple[int, ...],
    serving: bool = False,
    sums: tuple[Callable[[np.ndarray], np.ndarray], ...] = (energy,),
    tile_windows: int = TILE_WINDOWS,
) -> DataFrame:
    """event_id and n_i_j, m_i_j, s0_i_j, ... (count, largest magnitude, each of `sums` of the magnitudes, unknown ones -inf) within
    radius i and window j, of the query events that have any earlier event. The pairs are those of `near_past` for the widest
    radius and window.
    """
    radius, window = max(radii_km), max(windows_seconds)
    columns = ("event_id", "sort_time", "latitude", "longitude")
    # an unknown magnitude counts, but is no largest one
    dealt = in_tiles(queries, history, radius, window, F.coalesce(F.col("magnitude"), F.lit(-math.inf)), tile_windows)
    names = [f"{what}_{i}_{j}" for what in ("n", "m", *(f"s{k}" for k in range(len(sums)))) for i in range(len(radii_km)) for j in range(len(windows_seconds))]
    schema = ", ".join(["event_id long", *(f"{n} {'long' if n[0] == 'n' else 'double'}" for n in names)])
    height = radius / DEGREE_KM

    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sort_time", "ascending"), ("event_id", "ascending")])
        is_past = rows["half"].to_numpy() < 0
        q, p = ({c: rows[c].to_numpy()[of] for c in (*columns, "half", "magnitude")} for of in (~is_past, is_past))
        found = _tile_sums(q, p, radii_km, windows_seconds, height, serving, sums)
        some = found[0].any(axis=(1, 2))
        found = [x[some, i, j] for x in found for i in range(len(radii_km)) for j in range(len(windows_seconds))]
        return pa.table(dict(zip(["event_id", *names], [q["event_id"][some], *found])))

    found = dealt.applyInArrow(tile, schema)
    return found.groupBy("event_id").agg(*((F.max if n[0] == "m" else F.sum)(n).alias(n) for n in names))


def _unit(latitude: np.ndarray, longitude: np.ndarray) -> np.ndarray:
    up, along = np.radians(latitude), np.radians(longitude)
    return np.stack([np.cos(up) * np.cos(along), np.cos(up) * np.sin(along), np.sin(up)])


def _bounds(q: dict, p: dict, windows: list[int], serving: bool) -> np.ndarray:
    """Per query event the places in `p` where each window starts, widest first, and where the past ends."""
    starts = [np.searchsorted(p["sort_time"], q["sort_time"] - w) for w in reversed(windows)]
    if serving:
        return np.stack([*starts, np.searchsorted(p["sort_time"], q["sort_time"])], axis=1)
    old = np.repeat([0, 1], [len(q["event_id"]), len(p["event_id"])])
    order = np.lexsort((old, np.concatenate([q["event_id"], p["event_id"]]), np.concatenate([q["sort_time"], p["sort_time"]])))
    end = np.empty(len(old), dtype=np.int64)
    end[order] = np.cumsum(old[order])
    return np.stack([*starts, end[: len(q["event_id"])]], axis=1)


def _tile_sums(q: dict, p: dict, radii_km: tuple[int, ...], windows: tuple[int, ...], height: float, serving: bool, sums: tuple = (energy,)) -> list[np.ndarray]:
    """Counts, largest magnitudes (-inf: none) and `sums` of the events `q` by radius and window. `q` and `p` lie in order of time and id."""
    radii, spans = sorted(radii_km), sorted(windows)
    rings, ages, many = len(radii), len(spans), len(q["event_id"])
    bounds = _bounds(q, p, spans, serving)
    q_at, p_at = _unit(q["latitude"], q["longitude"]), _unit(p["latitude"], p["longitude"])
    chords = np.array([2 * math.sin(min(r / (2 * EARTH_KM), math.pi / 2)) for r in radii])
    magnitude, weights = p["magnitude"], [of(p["magnitude"]).astype(np.float64) for of in sums]
    n, m = np.zeros((many, rings, ages), dtype=np.int64), np.full((many, rings, ages), -np.inf)
    e = [np.zeros((many, rings, ages)) for _ in sums]

    for asked, left, edge in _halves(q, p, q_at, p_at, bounds, chords, height):
        if not edge:
            for ring, whole in left:
                if len(whole):
                    at = np.searchsorted(whole, bounds[asked])
                    some = np.diff(at, axis=1)
                    n[asked, ring] += some
                    for total, of, add, none in ((m, magnitude, np.maximum, -np.inf), *((x, w, np.add, 0.0) for x, w in zip(e, weights))):
                        parts = add.reduceat(np.append(of[whole], none), at.ravel()).reshape(at.shape)[:, :-1]
                        total[asked, ring] = add(total[asked, ring], np.where(some > 0, parts, none))
            continue
        near_at, latitude, longitude, heavy, sizes = p_at[:, left], p["latitude"][left], p["longitude"][left], [w[left] for w in weights], magnitude[left]
        for some, at in _slices(asked, np.searchsorted(left, bounds[asked])):
            lengths = at[:, -1] - at[:, 0]
            who = np.repeat(np.arange(len(some)), lengths)
            place = np.arange(len(who)) + np.repeat(at[:, 0] - np.cumsum(lengths) + lengths, lengths)
            square = sum((np.repeat(x[some], lengths) - y[place]) ** 2 for x, y in zip(q_at, near_at))
            kept = np.flatnonzero(square <= chords[-1] ** 2)
            who, place, square = who[kept], place[kept], square[kept]
            a = some[who]
            boxed = (np.abs(latitude[place] - q["latitude"][a]) <= height) & (np.abs(longitude[place] - q["longitude"][a]) <= q["half"][a])
            if not boxed.all():
                who, place, square = who[boxed], place[boxed], square[boxed]
            key = who * (rings * ages)
            for c in chords[:-1]:
                key += (square > c * c) * ages
            for j in range(1, ages):
                key += place >= at[who, j]
            size, shape = len(some) * rings * ages, (len(some), rings, ages)
            n[some] += np.bincount(key, minlength=size).reshape(shape)
            for total, w in zip(e, heavy):
                total[some] += np.bincount(key, weights=w[place], minlength=size).reshape(shape)
            most = np.full(size, -np.inf)
            np.maximum.at(most, key, sizes[place])
            m[some] = np.maximum(m[some], most.reshape(shape))

    # rings and stretches of time so far lie side by side, the oldest first; a disc and a window hold all nearer and later ones
    given = np.ix_(range(many), [radii.index(r) for r in radii_km], [spans.index(w) for w in windows])
    m = np.maximum.accumulate(np.maximum.accumulate(m[:, :, ::-1], axis=2), axis=1)
    n, *e = (x[:, :, ::-1].cumsum(2).cumsum(1) for x in (n, *e))
    return [x[given] for x in (n, m, *e)]


def _halves(q: dict, p: dict, q_at: np.ndarray, p_at: np.ndarray, bounds: np.ndarray, chords: np.ndarray, height: float) -> Iterator[tuple]:
    """(query events, earlier events, whether these must be looked at one by one); if not, they are pairs of a ring and its events.

    Distances are those of unit vectors, so that all of a half lies within its reach of its middle. They are told apart by squares in
    single precision from the middle of the tile, with more slack than their rounding; what is within it counts as edge.
    """
    if not len(q["event_id"]) or not len(p["event_id"]):
        return
    centre = (q_at.min(axis=1) + q_at.max(axis=1)) / 2
    own = (q_at.T - centre).astype(np.float32)
    square = ((p_at.T - centre) ** 2).sum(axis=1)
    terms = np.column_stack([p_at.T - centre, square]).astype(np.float32)
    slack = 32 * 2.0**-24 * 4 * max(float(square.max()), float((own**2).sum(axis=1).max()))
    stack = [(np.arange(len(own)), np.arange(len(terms)))]
    while stack:
        asked, left = stack.pop()
        at = own[asked]
        low, high = at.min(axis=0), at.max(axis=0)
        middle = ((low + high) / 2).astype(np.float64)
        reach = math.sqrt(((at - middle) ** 2).sum(axis=1).max()) + 1e-7 * float(np.abs(at).max()) + SLACK
        left = left[np.searchsorted(left, bounds[asked, 0].min()) : np.searchsorted(left, bounds[asked, -1].max())]
        away = terms[left] @ np.append(-2 * middle, 1.0).astype(np.float32)
        origin = float((middle**2).sum())
        near = np.flatnonzero(away <= (chords[-1] + reach) ** 2 - origin + slack)
        left, away = left[near], away[near]
        whole, edge = [], np.ones(len(left), dtype=bool)
        for i, chord in enumerate(chords):
            least, largest = chords[i - 1] + reach if i else -1.0, chord - reach
            if largest <= 0 or largest <= least:
                continue
            inside = away <= largest**2 - origin - slack
            if i:
                inside &= away > least**2 - origin + slack
            inside = np.flatnonzero(inside)
            for x, most in (("latitude", height), ("longitude", q["half"][asked].min())):
                place, mine = p[x][left[inside]], q[x][asked]
                inside = inside[(place - mine.min() <= most - 1e-9) & (mine.max() - place <= most - 1e-9)]
            edge[inside] = False
            whole.append((i, left[inside]))
        yield asked, whole, False
        left = left[edge]
        if not len(left):
            continue
        ends = np.searchsorted(left, bounds[asked][:, [0, -1]])
        if len(asked) == 1 or not (high > low).any() or (ends[:, 1] - ends[:, 0]).sum() <= FEW_PAIRS:
            yield asked, left, True
            continue
        # in order of time again, so that stretches of time follow each other
        half = np.argpartition(at[:, np.argmax(high - low)], len(asked) // 2)
        stack += [(np.sort(asked[some]), left) for some in (half[: len(asked) // 2], half[len(asked) // 2 :])]


def _slices(asked: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`asked` and `at` in slices of not too many pairs (or one event)."""
    ends = np.cumsum(at[:, -1] - at[:, 0])
    start = 0
    while start < len(asked):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        yield asked[start:stop], at[start:stop]
        start = stop
