"""Legs of tours in NumPy: rows of Arrow batches that come in order of tour_id, many tours at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from waymark.functions.sql import EARTH_M

#: Rows that are worked on at once, at least (where there are as many) and about at most.
ROWS = 100_000


def whole_tours(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The batches in larger ones that end where a tour does, with the rows at which tours begin."""
    held, n, last = [], 0, None

    def told():
        t = pa.Table.from_batches(held).combine_chunks()
        return t, np.concatenate([[0], _changes(t["tour_id"].combine_chunks())])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["tour_id"]
        cuts = _changes(key)
        if n >= rows and key[0] != last:
            yield told()
            held, n = [], 0
        elif n + batch.num_rows > rows and len(cuts):
            held.append(batch.slice(0, cuts[-1]))
            yield told()
            batch, held, n = batch.slice(cuts[-1]), [], 0
        held.append(batch)
        n, last = n + batch.num_rows, key[-1]
    if held:
        yield told()


def _changes(key: pa.Array) -> np.ndarray:
    """Rows that differ from the one before."""
    a, b = key[1:], key[:-1]
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_valid(), b.is_valid()))
    return np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1


def numbers(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table[name].to_numpy() if isinstance(table, pa.Table) else table[name].to_numpy(zero_copy_only=False) for name in names]


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that are wanted n times each: the row, and which of its times it is."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def slices(n: np.ndarray, most: int = ROWS) -> Iterator[slice]:
    """Rows in turn, as many at once as are wanted about `most` times in all."""
    bounds = np.flatnonzero(np.diff((np.cumsum(n) - 1) // most, prepend=-1))
    yield from (slice(a, b) for a, b in zip(bounds, [*bounds[1:], len(n)]))


def metres(lat1, lon1, lat2, lon2):
    """spatial.distance_m."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((np.radians(lat2 - lat1)) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def running(length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of a tour's rows up to each, added one after the other."""
    out, sizes = length.copy(), np.diff(np.append(starts, len(length)))
    for a, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        out[a : a + n] = np.cumsum(length[a : a + n])
    starts, sizes = starts[sizes <= 64], sizes[sizes <= 64]
    for k in range(1, sizes.max(initial=0)):
        at = starts[sizes > k] + k
        out[at] += out[at - 1]
    return out


def _shares(slope, offset, low, high):
    """The ends of all x with slope * x + offset between low and high; the first exceeds the second where there is none."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        a, b = (low - offset) / slope, (high - offset) / slope
    flat, inside = slope == 0, (low <= offset) & (offset <= high)
    return np.where(flat, np.where(inside, -np.inf, np.inf), np.minimum(a, b)), np.where(flat, np.where(inside, np.inf, -np.inf), np.maximum(a, b))


#: Columns of a pair of legs, after tour_id, ord and other.
WHOLE, REAL = ("low", "high", "r_first", "r_last"), ("lat", "lon", "dlat", "dlon", "since", "till", "length", "r_lat", "r_lon", "r_dlat", "r_dlon", "r_since", "r_length")


class Retraces:
    """routes.retrace_overlap in two steps: pairs of legs of which enough samples can meet, and the samples of such pairs."""

    def __init__(self, step_m: int, near_m: float, least_m: int, buffer_m: float):
        self.step, self.near, self.least, self.buffer = step_m, near_m, least_m, buffer_m

    def _reach(self, p: dict) -> tuple:
        """The farthest that samples in adjoining cells and within reach can be apart in latitude and longitude, with a margin for rounding."""
        near = np.degrees(self.near / EARTH_M) * 1.01
        top = np.maximum.reduce([np.abs(p["lat"]), np.abs(p["lat"] + p["dlat"]), np.abs(p["r_lat"]), np.abs(p["r_lat"] + p["r_dlat"])])
        return min(0.00202, near), np.minimum(0.00202, near / np.maximum(1e-6, np.cos(np.radians(np.minimum(89.9, top + 0.01)))))

    def _numbers(self, p: dict, side: str, ends: list) -> tuple:
        """The samples of a leg whose shares are between all ends."""
        at = lambda share: (p[f"{side}since"] + np.clip(share, -1.0, 2.0) * p[f"{side}length"]) / self.step
        return np.ceil(at(np.maximum.reduce([e[0] for e in ends]))), np.floor(at(np.minimum.reduce([e[1] for e in ends])))

    def pairs(self, batches):
        for t, starts in whole_tours(batches):
            ord_, *line, length = numbers(t, "ord", "lat", "lon", "lat2", "lon2", "length")
            length = np.where(length > 0, length, 0.0)
            till = running(length, starts)
            since = np.concatenate([[0.0], till[:-1]])
            since[starts] = 0.0
            final = np.zeros(len(till), bool)
            final[np.append(starts[1:], len(till)) - 1] = True
            first, last = np.ceil(since / self.step), np.where(final, np.floor(till / self.step), np.ceil(till / self.step) - 1)
            tour = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(till))))
            row = np.flatnonzero((length > 0) & (till > since) & (first <= last))
            leg = {"ord": ord_, "lat": line[0], "lon": line[1], "dlat": line[2] - line[0], "dlon": line[3] - line[1], "since": since, "till": till, "length": till - since, "first": first, "last": last}
            for apart in range(1, len(row)):
                i = np.flatnonzero(tour[row[apart:]] == tour[row[:-apart]])
                if not len(i):
                    break
                for a in range(0, len(i), ROWS):
                    yield self._met(t, leg, row[i[a : a + ROWS]], row[i[a : a + ROWS] + apart])

    def _met(self, t, leg: dict, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        p = {c: v[i] for c, v in leg.items()} | {f"r_{c}": v[j] for c, v in leg.items()}
        a, b, c, d, y, x = p["dlat"], p["dlon"], p["r_dlat"], p["r_dlon"], p["lat"] - p["r_lat"], p["lon"] - p["r_lon"]
        ey, ex = self._reach(p)
        # the shares f of a leg for which some share g of the other, 0 <= g <= 1, has |y + a f - c g| <= ey and |x + b f - d g| <= ex
        across = np.abs(d) * ey + np.abs(c) * ex
        ends = [_shares(a, y, np.minimum(0, c) - ey, np.maximum(0, c) + ey), _shares(b, x, np.minimum(0, d) - ex, np.maximum(0, d) + ex), _shares(d * a - c * b, d * y - c * x, -across, across)]
        low, high = self._numbers(p, "", ends)
        neighbour = p["r_ord"] - p["ord"] == 1
        p["low"], p["high"] = np.maximum(p["first"], low), np.minimum(np.minimum(p["last"], high), np.where(neighbour, np.floor((p["till"] - self.buffer) / self.step + 1e-6), np.inf))
        p["r_first"] = np.maximum(p["r_first"], np.where(neighbour, np.ceil((p["r_since"] + self.buffer) / self.step - 1e-6), -np.inf))
        # a sample meets no more of the other leg's than its reach is long
        with np.errstate(divide="ignore"):
            wide = np.minimum(np.minimum(2 * ey / np.abs(c), 2 * ex / np.abs(d)), 1.0)
        most = np.minimum(np.floor(wide * p["r_length"] / self.step + 1e-6) + 1, p["r_last"] - p["r_first"] + 1)
        # at least one: a sample without another counts nothing
        keep = (p["low"] <= p["high"]) & (most >= 1) & ((p["high"] - p["low"] + 1) * most * self.step >= self.least)
        ids = pa.array(i[keep])
        kept = [t["tour_id"].take(ids), t["ord"].take(ids), t["ord"].take(pa.array(j[keep]))]
        kept = [k.combine_chunks() for k in kept]
        cols = [pa.array(p[n][keep].astype("int64")) for n in WHOLE] + [pa.array(p[n][keep]) for n in REAL]
        return pa.RecordBatch.from_arrays([*kept, *cols], ["tour_id", "ord", "other", *WHOLE, *REAL])

    def counts(self, batches):
        for batch in batches:
            every = dict(zip(WHOLE + REAL + ("ord", "other"), numbers(batch, *WHOLE, *REAL, "ord", "other")))
            got = [self._counted({c: v[s] for c, v in every.items()}) for s in slices(every["high"] - every["low"] + 1)]
            total = np.concatenate([*got, np.zeros(0, "int64")]) * self.step
            keep = pa.array(np.flatnonzero((total >= self.least) & (total > 0)))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(keep) for c in ("tour_id", "ord", "other")), pa.array(total).take(keep)], ["tour_id", "ord", "other", "metres"])

    def _counted(self, p: dict) -> np.ndarray:
        """How many pairs of samples meet, for each pair of legs."""
        of, nth = spread(p["high"] - p["low"] + 1)
        s = {c: p[c][of] for c in ("lat", "lon", "dlat", "dlon", "since", "length", "r_lat", "r_lon", "r_dlat", "r_dlon", "r_since", "r_length")}
        k = p["low"][of] + nth
        f = (k * self.step - s["since"]) / s["length"]
        y, x = s["lat"] + s["dlat"] * f, s["lon"] + s["dlon"] * f
        ey, ex = self._reach(p)
        ends = [_shares(s["r_dlat"], s["r_lat"], y - ey, y + ey), _shares(s["r_dlon"], s["r_lon"], x - ex[of], x + ex[of])]
        low, high = self._numbers(s, "r_", ends)
        low, high = np.maximum(p["r_first"][of], low).astype("int64"), np.minimum(p["r_last"][of], high).astype("int64")
        at, more = spread(np.maximum(0, high - low + 1))
        r_k, of = low[at] + more, of[at]
        g = (r_k * self.step - s["r_since"][at]) / s["r_length"][at]
        y, x, r_y, r_x = y[at], x[at], s["r_lat"][at] + s["r_dlat"][at] * g, s["r_lon"][at] + s["r_dlon"][at] * g
        met = (np.abs(np.floor(y / 0.001) - np.floor(r_y / 0.001)) <= 1) & (np.abs(np.floor(x / 0.001) - np.floor(r_x / 0.001)) <= 1) & (metres(y, x, r_y, r_x) <= self.near)
        shared = (p["other"] - p["ord"] == 1)[of] & ((p["till"][of] - k[at] * self.step <= self.buffer) | (r_k * self.step - p["r_since"][of] <= self.buffer))
        return np.bincount(of[met & ~shared], minlength=len(p["low"]))


#: No hit; blocks of points at most; values that are worked on at once.
NONE, BLOCKS, VALUES = np.iinfo("int64").max, 512, 16_384
DEGREE_M = np.radians(1.0) * EARTH_M


class Spots:
    """Points in blocks, for the nearest positions of tours within reach of them. A hit is a long of whole metres and then
    thousandths of ord: per tour and point the least tells."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, c: np.ndarray, reach: float, members: list[np.ndarray]):
        """c is the cosine of lat; members are the points of each block."""
        self.reach, self.points, self.circles = float(reach), [(lat[m], lon[m], c[m]) for m in members], []
        for y, x, _ in self.points:
            mid_y, mid_x = (y.min() + y.max()) / 2, (x.min() + x.max()) / 2
            far = (self.reach + metres(mid_y, mid_x, y, x).max()) * 1.01 + 10
            # nothing within `far` of the middle is farther off in a plane whose degrees of longitude are as short as the shortest there
            least = np.cos(np.radians(min(90.0, abs(mid_y) + far / DEGREE_M)))
            least = least if far / DEGREE_M < 10 * least else 0.0
            turns = (0.0, -360.0, 360.0) if abs(mid_x) + far / DEGREE_M / max(least, 1e-9) > 180 else (0.0,)
            self.circles.append((mid_y, mid_x, least, far / DEGREE_M, turns))

    def near(self, legs: dict, b: int, among: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Legs that may come within reach of a point of block b, in order, and by how many degrees they are turned to meet it."""
        mid_y, mid_x, c, far, turns = self.circles[b]
        lat, lon, dy, dx = (legs[v][among] for v in ("lat", "lon", "dlat", "dlon"))
        found, dx, py = [], dx * c, mid_y - lat
        long2 = np.maximum(dx * dx + dy * dy, 1e-300)
        for turn in turns:
            px = (mid_x - turn - lon) * c
            t = np.clip((px * dx + py * dy) / long2, 0.0, 1.0)
            ox, oy = px - dx * t, py - dy * t
            found.append(np.flatnonzero(ox * ox + oy * oy <= far * far))
        at, by = np.concatenate(found), np.repeat(turns, [len(f) for f in found])
        order = np.argsort(at, kind="stable") if len(turns) > 1 else slice(None)
        return at[order] if isinstance(among, slice) else among[at[order]], by[order]

    def best(self, legs: dict, b: int, at: np.ndarray, turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For tours of the legs `at`, in order: the tours, and for each the least hit of each point of block b."""
        size, held = max(1, VALUES // len(self.points[b][0])), None
        for a in range(0, len(at), size):
            some = at[a : a + size]
            tour = legs["tour"][some]
            begun = np.flatnonzero(np.diff(tour, prepend=-1))
            hits, tour = np.minimum.reduceat(self._hits({c: legs[c][some][:, None] for c in ("lat", "lon", "dlat", "dlon", "ord", "length")}, turn[a : a + size, None], b), begun, axis=0), tour[begun]
            if held is not None:
                if held[0][0] == tour[0]:
                    hits[0] = np.minimum(hits[0], held[1][0])
                else:
                    yield held
            held = tour[-1:], hits[-1:]
            yield tour[:-1], hits[:-1]
        if held is not None:
            yield held

    def _hits(self, leg: dict, turn: np.ndarray, b: int) -> np.ndarray:
        lat, lon, c = self.points[b]
        x0, y0, dlon, dlat = leg["lon"] + turn, leg["lat"], leg["dlon"], leg["dlat"]
        n = np.maximum(1.0, np.ceil(leg["length"] / (2 * self.reach)))
        dx = dlon * c
        t = lon - x0
        t *= c
        t *= dx
        t += (lat - y0) * dlat
        dx *= dx
        dx += dlat * dlat
        t /= np.maximum(dx, 1e-300, out=dx)
        np.clip(t, 0.0, 1.0, out=t)
        exact = lambda i, j, at: np.floor(metres(lat[j], lon[j], y0[i, 0] + dlat[i, 0] * at, x0[i, 0] + dlon[i, 0] * at) + 0.5)
        # metres in a plane whose degrees of longitude are those midway; where that may round to another metre they are found exactly
        least, wide = self.circles[b][2], self.circles[b][3]
        unsure = 2 * self.reach * (self.reach / EARTH_M / max(least, 1e-9)) ** 2 + 1e-6
        y, x = dlat * t, dlon * t
        y += y0
        y -= lat
        x += x0
        x -= lon
        w = y * (-c * np.sin(np.radians(lat)) * np.radians(1.0))
        w += c * c
        if wide > 0.2:
            np.maximum(w, 0.0, out=w)
        x *= x
        x *= w
        y *= y
        x += y
        np.sqrt(x, out=x)
        x *= DEGREE_M
        x += 0.5
        off = np.floor(x)
        x -= off
        x -= 0.5
        i, j = np.nonzero((np.abs(x, out=x) > 0.5 - unsure) & (off <= self.reach + 1))
        if unsure > 0.1:
            i, j = np.nonzero(np.ones(off.shape, bool))
        off[i, j] = exact(i, j, t[i, j])
        np.add(leg["ord"], t, out=x)
        x *= 1000
        x += 0.5
        hits = off.astype("int64")
        hits <<= 40
        hits += np.floor(x, out=x).astype("int64")
        hits[off > self.reach] = NONE
        # a leg is cut into n: the cut before the foot's may end in the same metre, and then comes first
        t *= n
        np.floor(t, out=x)
        long = np.sqrt(np.maximum((dlon * least) ** 2 + dlat * dlat, 1e-300)) * DEGREE_M
        i, j = np.nonzero((t - x < n * (1.2 * np.sqrt(2 * self.reach + 2) + 2) / long) & (x >= 1) & (x < n))
        if len(i):
            at = x[i, j] / n[i, 0]
            before = exact(i, j, at)
            value = (before.astype("int64") << 40) + np.floor((leg["ord"][i, 0] + at) * 1000 + 0.5).astype("int64")
            hits[i, j] = np.minimum(hits[i, j], np.where(before <= self.reach, value, NONE))
        return hits


def blocks_of(*points: np.ndarray, side_m: float) -> list[np.ndarray]:
    """Rows whose points (lat and lon by turns) lie in the same cells, with cells so wide that there are BLOCKS at most."""
    side = side_m / DEGREE_M
    while True:
        _, block = np.unique(np.stack([np.floor(p / side) for p in points], 1), axis=0, return_inverse=True)
        block = block.reshape(-1)
        if block.max(initial=0) < BLOCKS:
            order = np.argsort(block, kind="stable")
            return [m for m in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(m)]
        side *= 2


def _legs(t: pa.Table, starts: np.ndarray) -> dict:
    """Legs of a table of stops with the next one's lat2 and lon2, which end at the last stop of a tour; `tour` counts tours."""
    ord_, lat, lon, lat2, lon2 = numbers(t, "ord", "lat", "lon", "lat2", "lon2")
    tour = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    legs = {"tour": tour, "ord": ord_, "lat": lat, "lon": lon, "dlat": lat2 - lat, "dlon": lon2 - lon, "length": metres(lat, lon, lat2, lon2)}
    whole = ~np.isnan(legs["length"])
    return {c: v[whole] for c, v in legs.items()}


def _told(t: pa.Table, starts: np.ndarray, found: Iterable[tuple], names: list[str], **lists: pa.Array) -> Iterator[pa.RecordBatch]:
    """found (tour, column, ...) as batches of tour_id, what lists have for the tour, and the columns."""
    ids = t["tour_id"].combine_chunks().take(pa.array(starts))
    held, n = [], 0
    for some in (*found, None):
        if some is not None:
            held.append(some)
            n += len(some[0])
        if held and (some is None or n >= ROWS):
            tour, *cols = (np.concatenate(c) for c in zip(*held))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(tour)), *(v.take(pa.array(tour)) for v in lists.values()), *map(pa.array, cols)], ["tour_id", *lists, *names])
            held, n = [], 0


def point_hits(spots: Spots, place: list[np.ndarray]):
    """A function of batches of legs: hits (tour_id, place, metres, position), place being the id of each point of a block."""

    def found(legs):
        for b in range(len(place)):
            for tour, best in spots.best(legs, b, *spots.near(legs, b)):
                best = best.ravel()
                at = np.flatnonzero(best < NONE)
                hit, of = best[at], at // len(place[b])
                yield tour[of], place[b][at - of * len(place[b])], hit >> 40, (hit & ((1 << 40) - 1)) / 1000

    def run(batches):
        for t, starts in whole_tours(batches):
            yield from _told(t, starts, found(_legs(t, starts)), ["place", "metres", "position"])

    return run


def crossings(kinds: list[Spots], system: list[np.ndarray], sides: bool):
    """A function of batches of legs with the pass_id of their first stops: (tour_id, planned, system, S, A, B) where a tour hits all
    three points of a system, planned being the passes of all stops of the tour, and S, A and B the hits; unless `sides`, only
    where those of A and B are on opposite sides of that of S."""

    def found(legs):
        for b, names in enumerate(system):
            near, among = [], slice(None)
            for k in kinds:  # of tours that are near all kinds so far
                near.append(k.near(legs, b, among))
                met = np.zeros(legs["tour"][-1:].max(initial=-1) + 1, bool)
                met[legs["tour"][near[-1][0]]] = True
                among = np.flatnonzero(met[legs["tour"]])
            tours = np.flatnonzero(met)
            size = max(1, 8 * VALUES // len(names))
            for a in range(0, len(tours), size):
                some = tours[a : a + size]
                hits = np.full((len(kinds), len(some), len(names)), NONE)
                for k, (at, turn), its in zip(kinds, near, hits):
                    mine = np.isin(legs["tour"][at], some)
                    for tour, best in k.best(legs, b, at[mine], turn[mine]):
                        its[np.searchsorted(some, tour)] = best
                met = (hits < NONE).all(0)
                if not sides:
                    at = hits & ((1 << 40) - 1)
                    met &= (at[1] < at[0]) != (at[2] < at[0])
                i, j = np.nonzero(met)
                yield some[i], names[j], *(its[i, j] for its in hits)

    def run(batches):
        for t, starts in whole_tours(batches):
            passes = t["pass_id"].combine_chunks()
            known = passes.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(known)])[np.append(starts, len(t))]
            planned = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), passes.drop_null())
            yield from _told(t, starts, found(_legs(t, starts)), ["system", "S", "A", "B"], planned=planned)

    return run
