"""The sequential merge loop over a bounded set of points, in numpy; no Spark here.

Every step merges the closest pair of clusters (ties to the smaller slots; points
come sorted by id, and a merged cluster keeps the smaller slot). A cluster keeps up to
c scattered members as representatives, moved towards its centre; their unmoved forms are
kept beside them, so that no step has to invert the move.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np

EPS = 1e-10
#: Components up to which differences are formed; longer vectors use the expanded product.
DIRECT = 8


def unit_forms(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to length 1; zero where a row has no variance."""
    z = x - x.mean(axis=1, keepdims=True)
    n = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return np.where(n < EPS, 0.0, z / np.where(n < EPS, 1.0, n))


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of ``a`` and ``b``."""
    d = a.shape[1]
    if metric == "pearson" and d > 1:
        return 1.0 - np.clip(unit_forms(a) @ unit_forms(b).T, -1.0, 1.0)
    if d <= DIRECT:
        out = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    else:
        out = np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)))
    if metric == "pearson":
        bound = np.maximum(np.maximum(np.abs(a), np.abs(b).T), EPS)
        return np.minimum(out / bound, 2.0)
    return out


def scattered(candidates: np.ndarray, center: np.ndarray, c: int, metric: str) -> np.ndarray:
    """Rows of up to ``c`` scattered candidates: the farthest from the centre, then always the farthest from those chosen."""
    near = distances(candidates, center[None, :], metric)[:, 0]
    chosen = [int(np.argmax(near))]
    used = (candidates == candidates[chosen[0]]).all(axis=1)
    near = np.full(len(candidates), np.inf)
    while len(chosen) < c and not used.all():
        near = np.minimum(near, distances(candidates, candidates[chosen[-1]][None, :], metric)[:, 0])
        best = int(np.argmax(np.where(used, -np.inf, near)))
        chosen.append(best)
        used |= (candidates == candidates[best]).all(axis=1)
    return np.array(chosen)


def medoid(x: np.ndarray, metric: str) -> np.ndarray:
    """The row with the least summed distance to all rows."""
    if metric == "pearson" and x.shape[1] > 1:
        z = unit_forms(x)
        return x[int(np.argmin(len(x) - z @ z.sum(axis=0)))]
    return x[int(np.argmin(distances(x, x, metric).sum(axis=1)))]


def distinct_rows(x: np.ndarray) -> np.ndarray:
    _, at = np.unique(x, axis=0, return_index=True)
    return x[np.sort(at)]


@dataclass
class Cluster:
    """Members by row number, centre, and representatives: ``plain`` as they were, ``reps`` moved towards the centre."""

    members: np.ndarray
    center: np.ndarray
    plain: np.ndarray
    reps: np.ndarray


@dataclass
class Result:
    clusters: list[Cluster]
    merges: list[tuple[int, int, float]] = field(default_factory=list)

    def labels(self, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        for i, c in enumerate(self.clusters):
            out[c.members] = i
        return out


def merged(x: np.ndarray, u: Cluster, v: Cluster, c: int, alpha: float, metric: str, center: str = "mean", candidates: str = "representatives") -> Cluster:
    """The union of two clusters with its own centre and representatives."""
    members = np.concatenate([u.members, v.members])
    middle = medoid(x[members], metric) if center == "medoid" else x[members].mean(axis=0)
    pool = distinct_rows(np.concatenate([u.plain, v.plain])) if candidates == "representatives" else x[np.sort(members)]
    if len(pool) < c:
        pool = x[np.sort(members)]
    plain = pool[scattered(pool, middle, c, metric)]
    return Cluster(members, middle, plain, plain + alpha * (middle - plain))


def formed(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows in the form that ``between`` takes."""
    return unit_forms(x) if metric == "pearson" and x.shape[1] > 1 else x


def between(a: np.ndarray, b: np.ndarray, metric: str, squares: np.ndarray | None = None) -> np.ndarray:
    """``distances`` of formed rows; ``squares``: the squared lengths of ``b``, where they are known."""
    d = a.shape[1]
    if metric == "pearson" and d > 1:
        out = a @ b.T
        np.clip(out, -1.0, 1.0, out=out)
        return np.subtract(1.0, out, out=out)
    if metric == "pearson":
        return distances(a, b, metric)
    if d <= DIRECT:
        out = np.zeros((len(a), len(b)))
        for i in range(d):
            step = a[:, i, None] - b[None, :, i]
            out += np.multiply(step, step, out=step)
    else:
        out = a @ b.T
        out *= -2
        out += (a * a).sum(1)[:, None]
        out += (b * b).sum(1) if squares is None else squares
        np.maximum(out, 0.0, out=out)
    return np.sqrt(out, out=out)


def exactly(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The least distance of each row of ``b`` to the formed rows ``a``, found alike whatever other rows there are.

    A correlation is kept to 40 bits, so that what differs by rounding alone is equal.
    """
    out = np.full(len(b), np.inf)
    for r in a:
        if metric == "pearson":
            out = np.minimum(out, np.rint((1.0 - np.clip((b * r).sum(axis=1), -1.0, 1.0)) * 2.0**40) / 2.0**40)
        else:
            step = b - r
            out = np.minimum(out, np.sqrt((step * step).sum(axis=1)))
    return out


class Extreme:
    """The member of the largest score against a reference, in a cluster that grows.

    A score changes by at most the way that its reference goes. ``keys`` are bounds less the way gone so far, so only
    members whose bound reaches the best are scored again. Scores that differ by rounding alone are ties, to the smaller row.
    """

    def __init__(self, members: np.ndarray, reference: np.ndarray, scores: np.ndarray):
        self.reference, self.gone, self.keys = reference, 0.0, scores
        self.best = self.choose(members, scores)

    @staticmethod
    def choose(rows: np.ndarray, scores: np.ndarray) -> int:
        top = scores.max()
        return int(rows[scores >= top - 1e-12 * max(1.0, abs(top))].min())

    def grow(self, large: np.ndarray, small: np.ndarray, reference: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """``large``: the members so far; ``small``: those that join them."""
        self.gone += float(np.linalg.norm(reference - self.reference))
        self.reference = reference
        new = score(small, reference)
        least = max(new.max(), score(np.array([self.best]), reference)[0])
        again = np.flatnonzero(self.keys + self.gone >= least - 1e-9 * max(1.0, abs(least), self.gone))
        scores = score(large[again], reference)
        self.keys[again] = scores - self.gone
        self.keys = np.concatenate([self.keys, new - self.gone])
        self.best = self.choose(np.concatenate([large[again], small]), np.concatenate([scores, new]))


@dataclass
class Part:
    """A cluster while it grows: rows of its different points, number of all, their sum, chosen rows with their
    distance when chosen, moved representatives and where they lie, and its medoid or farthest member."""

    members: np.ndarray
    size: int
    total: np.ndarray
    center: np.ndarray
    plain: list[int]
    reps: np.ndarray
    lies: np.ndarray
    far: list[float] = field(default_factory=list)
    extreme: Extreme | None = None


#: Numbers in a block of distances of short and of long vectors, and representatives looked up at once.
SMALL_BLOCK, BLOCK, LOOKUPS = 1 << 17, 2 << 20, 16


class Merging:
    """Clusters while they are merged, without a table of all pairs.

    The representatives of all live clusters lie in one array, each with the slot that owns it. A slot keeps its nearest slot
    and a lower bound on its distance to every other; where a merge leaves it with the bound alone, its nearest is looked
    up again no sooner than the bound is the least of all. So memory is linear in the points, a merge is one pass over the
    live representatives, and the pair that is merged is the closest of all.
    """

    def __init__(self, x: np.ndarray, counts: np.ndarray, c: int, alpha: float, metric: str, center: str, candidates: str, parts: list[Part] | None = None):
        """``parts``: clusters of all rows to go on with, by their smallest row; none: every row is one."""
        self.x, self.c, self.alpha, self.metric, self.center, self.candidates = x, c, alpha, metric, center, candidates
        self.form = formed(x, metric)
        self.kind = np.unique(x + 0.0, axis=0, return_inverse=True)[1].reshape(-1)
        self.expanded = metric == "euclidean" and x.shape[1] > DIRECT
        self.bounded = metric == "euclidean" or x.shape[1] > 1
        self.medoids = center == "medoid"
        self.counts = counts
        self.parts: list[Part | None] = parts or [Part(np.array([i]), int(counts[i]), x[i] * counts[i], x[i], [i], x[i : i + 1], np.array([i]), [0.0]) for i in range(len(x))]
        n = len(self.parts)
        self.form_squares = (self.form * self.form).sum(1) if self.expanded else None
        self.shift = x.mean(axis=0) if self.expanded else 0.0
        reach = float(((x - self.shift) ** 2).sum(1).max()) if self.expanded else 1.0
        self.single = (self.expanded or (metric == "pearson" and x.shape[1] > 1)) and 1e-20 < reach < 1e20
        # of a sum of d products of vectors of that length, of their rounding and of the last additions
        self.slack = (2 * x.shape[1] + 40) * 2.0**-24 * reach if self.single else 0.0
        self.factor = np.float32(-2.0 if self.expanded else -1.0)
        self.name = np.array([p.members.min() for p in self.parts])
        self.lay_out()
        self.place(formed(np.concatenate([p.reps for p in self.parts]), metric))
        self.live, self.failed = n, 0
        self.near, self.dist, self.bound, self.rough = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        step = max(1, (BLOCK if self.single or x.shape[1] > DIRECT else SMALL_BLOCK) // n)
        for at in range(0, n, step):
            slots = np.arange(at, min(n, at + step))
            table = self.scores([self.rep[self.parts[i].lies] for i in slots])
            self.settle(slots, table if len(self.rep) == n else np.stack([self.by_slot(r) for r in table]))

    def lay_out(self) -> None:
        """Let the representatives lie in the order of their slots."""
        lengths = [len(p.reps) for p in self.parts]
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        for p, end in zip(self.parts, np.cumsum(lengths), strict=True):
            p.lies = np.arange(end - len(p.reps), end)

    def place(self, rep: np.ndarray) -> None:
        """Representatives of all slots; where passes go over them as they are, single components lie in a row, which is faster."""
        self.rep = rep if self.single else np.asfortranarray(rep)
        self.passed = self.narrow(self.rep) if self.single else self.rep
        self.squares = self.lengths(self.rep) if self.expanded else None

    def narrow(self, a: np.ndarray) -> np.ndarray:
        return (a - self.shift).astype(np.float32, order="C")

    def lengths(self, a: np.ndarray) -> np.ndarray:
        """Squared lengths as the passes take them."""
        if not self.single:
            return (a * a).sum(1)
        return ((a - self.shift) ** 2).sum(1).astype(np.float32)

    def scores(self, groups: list[np.ndarray]) -> np.ndarray:
        """For each group of formed rows the least to every representative: values that ``lower`` turns into distances."""
        a = groups[0] if len(groups) == 1 else np.concatenate(groups)
        ends = np.cumsum([len(g) for g in groups])
        if not self.single:
            out = between(a, self.rep, self.metric, self.squares)
        elif len(groups) == 1:  # few columns on the right are the faster product
            out = (self.passed @ (self.factor * self.narrow(a)).T).T
        else:
            out = (self.factor * self.narrow(a)) @ self.passed.T
        if self.single and self.expanded:
            out += self.lengths(a)[:, None]
        if len(a) > len(groups):
            out = np.stack([reduce(np.minimum, out[end - len(g) : end]) for g, end in zip(groups, ends, strict=True)])
        if self.single and self.expanded:
            out += self.squares
        return out

    def lower(self, scores: np.ndarray) -> np.ndarray:
        """Distances, or lower bounds on them where scores are of single precision."""
        if not self.single:
            return scores
        out = np.maximum(0.0, scores.astype(float) + ((0.0 if self.expanded else 1.0) - self.slack))
        return np.sqrt(out) if self.expanded else out

    def settle(self, slots: np.ndarray, table: np.ndarray) -> None:
        """Nearest slot, its distance, and the bound on all others, from scores of all slots; the table is used up."""
        at = np.arange(len(slots))
        table[at, slots] = np.inf
        near = table.argmin(axis=1)
        self.near[slots], self.dist[slots], self.rough[slots] = near, self.lower(table[at, near]), self.single
        table[at, near] = np.inf
        self.bound[slots] = self.lower(table.min(axis=1))

    def by_slot(self, per_rep: np.ndarray) -> np.ndarray:
        """The least to each slot, from those to all representatives."""
        row = np.full(len(self.parts) + 1, np.inf, per_rep.dtype)
        np.minimum.at(row, self.owner, per_rep)
        return row[:-1]

    def look_up(self) -> None:
        """Find the nearest slot of those whose bound is the least, some at once."""
        waiting = np.flatnonzero((self.near < 0) & np.isfinite(self.dist))
        if len(waiting) > LOOKUPS:
            waiting = waiting[np.argpartition(self.dist[waiting], LOOKUPS)[:LOOKUPS]]
        # the least of all comes first, so it is among them
        waiting = waiting[np.lexsort((waiting, self.dist[waiting]))]
        lies = [self.parts[s].lies for s in waiting]
        most = max(1, int(np.searchsorted(np.cumsum([len(v) for v in lies]), LOOKUPS, "right")))
        waiting, lies = waiting[:most], lies[:most]
        table = np.stack([self.by_slot(r) for r in self.scores([self.rep[v] for v in lies])])
        if not self.single:
            self.settle(waiting, table)
            return
        for s, own, row in zip(waiting, lies, table, strict=True):
            row[s] = np.inf
            close = np.zeros(len(row) + 1, bool)
            close[:-1] = row <= row.min() + 2.001 * self.slack
            rows = np.flatnonzero(close[self.owner])
            apart = np.full(len(row), np.inf)
            np.minimum.at(apart, self.owner[rows], exactly(self.rep[own], self.rep[rows], self.metric))
            near = int(apart.argmin())
            self.near[s], self.dist[s], self.rough[s] = near, apart[near], False
            apart[near] = np.inf
            row[close[:-1]] = np.inf
            self.bound[s] = min(float(apart.min()), float(self.lower(row.min())))

    def refine(self, slots: np.ndarray) -> None:
        """Find the distances of rough slots; where another may be as near, the nearest is looked up again."""
        for s in slots:
            apart = exactly(self.rep[self.parts[s].lies], self.rep[self.parts[self.near[s]].lies], self.metric).min()
            self.rough[s] = False
            if apart < self.bound[s]:
                self.dist[s] = apart
            else:
                self.near[s], self.dist[s] = -1, self.bound[s]
                self.failed += 1
        if self.failed > 100 + (len(self.x) - self.live) // 20:
            self.go_double()

    def go_double(self) -> None:
        """Where too many distances are closer than single precision can tell, go on in double precision."""
        at = np.flatnonzero(self.rough)
        self.near[at], self.bound[at], self.rough[at] = -1, self.dist[at], False
        self.single = False
        self.place(self.rep)

    def compact(self) -> None:
        """Leave out what is no more; the order of the slots stays."""
        alive = np.array([i for i, p in enumerate(self.parts) if p is not None])
        place = np.full(len(self.parts) + 1, -1)
        place[alive] = np.arange(len(alive))
        self.parts = [self.parts[i] for i in alive]
        self.name = self.name[alive]
        self.near = np.where(self.near[alive] < 0, -1, place[self.near[alive]])
        self.dist, self.bound, self.rough = self.dist[alive], self.bound[alive], self.rough[alive]
        self.place(self.rep[np.concatenate([p.lies for p in self.parts])])
        self.lay_out()

    def away(self, rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
        """Distances of points to a formed reference."""
        squares = None if self.form_squares is None else self.form_squares[rows]
        return between(reference[None, :], self.form[rows], self.metric, squares)[0]

    def inward(self, rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
        return self.form[rows] @ reference

    def grown(self, u: Part, v: Part, reference: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Extreme:
        """The extreme member of two clusters as one; the members of the larger come first."""
        large, small = (u, v) if len(u.members) >= len(v.members) else (v, u)
        e = large.extreme
        if e is None:
            members = np.concatenate([large.members, small.members])
            return Extreme(members, reference, score(members, reference))
        e.grow(large.members, small.members, reference, score)
        return e

    def from_all(self, u: Part, v: Part, middle: np.ndarray) -> tuple[list[int], list[float], Extreme | None]:
        """Scattered ones of all members. As long as the larger cluster's own choice holds, only the smaller one's members are looked at."""
        large, small = (u, v) if len(u.members) >= len(v.members) else (v, u)
        extreme = None
        if self.bounded:
            extreme = self.grown(u, v, formed(middle[None, :], self.metric)[0], self.away)
            chosen = [extreme.best]
        else:
            rows = np.concatenate([large.members, small.members])
            chosen = [Extreme.choose(rows, self.away(rows, middle))]
        far = [np.inf]
        same = chosen[0] == large.plain[0]
        rows = small.members if same else np.concatenate([large.members, small.members])
        least = np.full(len(rows), np.inf)
        while len(chosen) < self.c:
            if same and len(chosen) > 1 and chosen[-1] != (large.plain[len(chosen) - 1] if len(chosen) <= len(large.plain) else None):
                same = False
                rows = np.concatenate([large.members, small.members])
                least = np.min([self.away(rows, self.form[r]) for r in chosen[:-1]], axis=0)
            least = np.minimum(least, self.away(rows, self.form[chosen[-1]]))
            least[np.isin(self.kind[rows], self.kind[chosen])] = -np.inf
            top = least.max(initial=-np.inf)
            own = [(float(top), int(rows[least == top].min()))] if top > -np.inf else []
            if same and len(chosen) < len(large.plain) and self.kind[large.plain[len(chosen)]] not in self.kind[chosen]:
                own.append((large.far[len(chosen)], large.plain[len(chosen)]))
            if not own:
                break
            value, row = min(own, key=lambda o: (-o[0], o[1]))
            chosen.append(row)
            far.append(value)
        return chosen, far, extreme

    def from_representatives(self, u: Part, v: Part, middle: np.ndarray) -> list[int]:
        """Scattered ones of both clusters' own; where those are too few, they are all there are, in the order of their rows."""
        first: dict[int, int] = {}
        for row in (*u.plain, *v.plain):
            kind = self.kind[row]
            first[kind] = min(row, first.get(kind, row))
        pool = np.array(list(first.values()))
        if len(pool) < self.c:
            pool = np.sort(pool)
        rows = self.form[pool]
        apart = between(rows, rows, self.metric)
        chosen = [int(between(rows, formed(middle[None, :], self.metric), self.metric)[:, 0].argmax())]
        near = np.full(len(pool), np.inf)
        while len(chosen) < min(self.c, len(pool)):
            near = np.minimum(near, apart[chosen[-1]])
            near[chosen[-1]] = -np.inf
            chosen.append(int(near.argmax()))
        return pool[chosen].tolist()

    def union(self, u: Part, v: Part) -> Part:
        size, total, extreme, far = u.size + v.size, u.total + v.total, None, []
        large, small = (u, v) if len(u.members) >= len(v.members) else (v, u)
        members = np.concatenate([large.members, small.members])
        middle = total / size
        if self.medoids and self.metric == "pearson" and self.bounded:
            inner = [p.extreme.reference if p.extreme else self.form[p.members[0]] for p in (u, v)]
            extreme = self.grown(u, v, inner[0] + inner[1], self.inward)
            middle = self.x[extreme.best]
        elif self.medoids:
            middle = medoid(self.x[np.sort(members)], self.metric)
        if self.candidates == "representatives":
            plain = self.from_representatives(u, v, middle)
        elif self.medoids:
            rows = np.sort(members)
            plain = rows[scattered(self.x[rows], middle, self.c, self.metric)].tolist()
        else:
            plain, far, extreme = self.from_all(u, v, middle)
        points = self.x[plain]
        return Part(members, size, total, middle, plain, points + self.alpha * (middle - points), np.empty(0, int), far, extreme)

    def closest(self) -> int | None:
        """The smaller slot of the closest pair, its nearest found; None where no distance is finite."""
        while True:
            u = int(np.argmin(self.dist))
            if not np.isfinite(self.dist[u]):
                return None
            if self.near[u] < 0:
                self.look_up()
            elif self.rough[u]:
                self.refine(np.flatnonzero(self.rough & (self.dist <= self.dist[u])))
            else:
                return u

    def merge(self) -> tuple[int, int, float] | None:
        """Merge the closest pair; None where no distance is finite."""
        u = self.closest()
        if u is None:
            return None
        apart = float(self.dist[u])
        u, v = sorted((u, int(self.near[u])))
        p, q = self.parts[u], self.parts[v]
        made = self.union(p, q)
        lies = np.concatenate([p.lies, q.lies])
        made.lies, gone = lies[: len(made.reps)], lies[len(made.reps) :]
        own = formed(made.reps, self.metric)
        self.rep[made.lies] = own
        if self.single:
            self.passed[made.lies] = self.narrow(own)
        if self.squares is not None:
            self.squares[made.lies] = self.lengths(own)
        self.owner[made.lies], self.owner[gone] = u, len(self.parts)
        self.parts[u], self.parts[v] = made, None
        self.live -= 1
        row = self.lower(self.by_slot(self.scores([own])[0]))
        self.dist[v] = self.bound[v] = row[u] = np.inf
        near, dist, bound, rough = self.near, self.dist, self.bound, self.rough
        lost = np.flatnonzero((near == u) | (near == v))
        near[lost], dist[lost], rough[lost] = -1, bound[lost], False
        closer = np.flatnonzero((row < dist) | ((row == dist) & (u < near)))
        second = np.where(near[closer] < 0, bound[closer], dist[closer])
        np.minimum(bound, row, out=bound)  # those that wait have a bound no larger, or are closer
        near[closer], dist[closer], bound[closer], rough[closer] = u, row[closer], second, self.single
        nearest = int(row.argmin())
        self.near[u], self.dist[u], self.rough[u] = nearest, row[nearest], self.single
        row[nearest] = np.inf
        self.bound[u] = row.min()
        name = (int(self.name[u]), int(self.name[v]), apart)
        if self.live < 0.75 * len(self.parts):
            self.compact()
        return name


#: Of all gaps between neighbouring values, so many of the largest are looked at.
MOST_GAPS = 1024


def apart(x: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Sections of the rows, and how far two sections are apart at least.

    They are cut where neighbouring values of a component have a gap above the largest relative step between gaps; where that
    leaves most rows in one section, all are one.
    """
    whole = [np.arange(len(x))], np.inf
    values = [np.unique(r) for r in x.T]
    gaps = np.sort(np.concatenate([np.diff(v) for v in values]))[-MOST_GAPS:]
    if len(gaps) < 2:
        return whole
    least = float(gaps[1:][np.argmax(gaps[1:] / gaps[:-1])])
    cells = np.stack([np.searchsorted(v[1:][np.diff(v) >= least], r, "right") for v, r in zip(values, x.T, strict=True)], axis=1)
    section = np.unique(cells, axis=0, return_inverse=True)[1].reshape(-1)
    sizes = np.bincount(section)
    # what is computed of a section may lie outside its hull by rounding
    least -= 1e-9 * float(np.abs(x).max())
    if sizes.max() > 0.75 * len(x) or least <= 0:
        return whole
    return np.split(np.argsort(section, kind="stable"), np.cumsum(sizes)[:-1]), least


def merge_down(x: np.ndarray, counts: np.ndarray, k: int, c: int, alpha: float, metric: str, center: str, candidates: str) -> tuple[list[Part], list[tuple[int, int, float]]]:
    """Clusters of the rows, and the merges that led to them.

    In few components, sections that lie apart are merged each on its own, the closest pair of all first: representatives stay
    within the hull of their members, so no pair of two sections is closer than the sections are. From there on all are merged together.
    """
    how = c, alpha, metric, center, candidates
    sections, least = apart(x) if metric == "euclidean" and x.shape[1] <= DIRECT else ([np.arange(len(x))], np.inf)
    works = [Merging(x[own], counts[own], *how) for own in sections]
    merges: list[tuple[int, int, float]] = []
    heads: list[tuple[float, int, int]] = []

    def wait(i: int) -> None:
        if (u := works[i].closest()) is not None:
            heapq.heappush(heads, (float(works[i].dist[u]), int(sections[i][works[i].name[u]]), i))

    for i in range(len(works)):
        wait(i)
    while len(x) - len(merges) > k and heads and heads[0][0] < least:
        i = heapq.heappop(heads)[2]
        u, v, distance = works[i].merge()
        merges.append((int(sections[i][u]), int(sections[i][v]), distance))
        wait(i)
    parts = []
    for own, work in zip(sections, works, strict=True):
        for p in filter(None, work.parts):
            p.members, p.plain = own[p.members], own[p.plain].tolist()
            if p.extreme:
                p.extreme.best = int(own[p.extreme.best])
            parts.append(p)
    parts.sort(key=lambda p: p.members.min())
    if len(works) == 1 or len(parts) <= k:
        return parts, merges
    work = Merging(x, counts, *how, parts)
    while work.live > k and (pair := work.merge()):
        merges.append(pair)
    return [p for p in work.parts if p is not None], merges


def agglomerate(x: np.ndarray, k: int, c: int, alpha: float, metric: str = "euclidean", center: str = "mean", candidates: str = "representatives") -> Result:
    """Merge the rows of ``x`` down to ``k`` clusters, ordered by their first row.

    Equal rows have Euclidean distance zero and are merged before all others; they go into the loop as one.
    """
    n = len(x)
    group: dict[bytes, list[int]] = {}
    if metric == "euclidean" and center == "mean":
        for i, r in enumerate(np.ascontiguousarray(x + 0.0)):
            group.setdefault(r.tobytes(), []).append(i)
    else:
        group = {i.to_bytes(8, "big"): [i] for i in range(n)}
    merges: list[tuple[int, int, float]] = []
    rows: list[list[int]] = []
    for own in group.values():
        at = min(len(own), n - k - len(merges) + 1) if n > k else 1
        merges += [(own[0], i, 0.0) for i in own[1:at]]
        rows += [own[:at], *([i] for i in own[at:])]
    rows.sort(key=lambda r: r[0])
    first = np.array([r[0] for r in rows], dtype=np.int64)
    if len(rows) <= k:
        return Result([Cluster(np.array(r), x[r[0]], x[r[:1]], x[r[:1]]) for r in rows], merges)
    distinct = x[first]
    parts, more = merge_down(distinct, np.array([len(r) for r in rows]), k, c, alpha, metric, center, candidates)
    merges += [(int(first[u]), int(first[v]), distance) for u, v, distance in more]
    return Result([Cluster(np.concatenate([rows[i] for i in p.members]), p.center, distinct[p.plain], p.reps) for p in parts], merges)


def nearest_rep(x: np.ndarray, reps: np.ndarray, labels: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(label, distance) of the nearest representative of each row; ties to the smaller label, then the earlier one."""
    order = np.argsort(labels, kind="stable")
    reps, labels = reps[order], labels[order]
    out = np.zeros(len(x), dtype=np.int64)
    dist = np.zeros(len(x))
    step = max(1, (1 << 20) // max(1, len(reps) * (x.shape[1] if x.shape[1] <= DIRECT else 1)))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], reps, metric)
        best = d.argmin(axis=1)
        out[at : at + step] = labels[best]
        dist[at : at + step] = d[np.arange(len(d)), best]
    return out, dist
