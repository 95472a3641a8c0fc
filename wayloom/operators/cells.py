"""Searches over a graph cut into cells: a round crosses a cell, not an edge.

Nodes lie in cells of bounded size along a space-filling curve. A label that enters a cell is an entry;
only entries are kept between rounds. A round brings the entries of every search and cell that
something new has entered together with the cell's edges, follows them inside the cell to
their end, and yields the best ways out. A hot cell is dealt into several units by search.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import graph

#: Nodes of a cell at most, and searches of a unit of work on average.
CELL_NODES, UNIT = 16_384, 64

#: Searches that a sweep follows side by side, and how many more than ``UNIT`` a unit of sweeps has.
SIDE, SWEPT = 32, 4

#: Nodes of a cell at most where few searches go over the whole graph.
WIDE_NODES = 131_072

#: Nodes of a home cell at most, for all searches and then for those left, and how many cells around it its region has at most.
HOME_NODES, AROUND = (8_192, 32_768), 8

#: Numbers of speed profiles that a cell should hold at most.
PROFILE_VALUES = 1 << 21

#: Columns of searches that name what they may not use.
FORBIDDEN = ("forbidden_nodes", "forbidden_road_types", "forbidden_edges")

#: Relative error granted to sums of lengths before a bound may leave a label out.
SLACK = 1e-9


def _interleaved(x: Column) -> Column:
    """The lower 16 bits of ``x`` with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve(nodes: DataFrame) -> Column:
    """The place of lat and lon on a Z curve over the box that holds all ``nodes``."""
    box = nodes.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    wide = max((box[1] or 0) - (box[0] or 0), (box[3] or 0) - (box[2] or 0)) or 1.0
    bits = lambda c, low: _interleaved(F.least(F.floor((F.col(c) - F.lit(low or 0.0)) * F.lit(65535 / wide)), F.lit(65535)).cast("long"))
    return bits("lat", box[0]).bitwiseOR(F.shiftleft(bits("lon", box[2]), 1))


def assign(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """node, cell: each cell has at most ``most`` nodes, whatever their density.

    ``nodes``: id and, if known, lat and lon. Nodes are put in order along a Z curve (by id where
    there are no coordinates) by one range shuffle and cut into runs within each partition.
    """
    if {"lat", "lon"} <= set(nodes.columns):
        key = curve(nodes)
    else:
        key = F.col("id")
    rows = nodes.select(F.col("id").alias("node"), key.alias("_z")).dropDuplicates(["node"])
    dealt = rows.repartitionByRange("_z", "node").sortWithinPartitions("_z", "node").withColumn("_at", F.monotonically_increasing_id())
    run = F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(most or CELL_NODES)).cast("long")
    return graph.cut(dealt.select("node", F.shiftleft(F.shiftright("_at", 33), 32).bitwiseOR(run).alias("cell")))


def packed(edges: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each cell with edges: cell, and ``columns`` and ``to`` (the cell of dst) of its edges as arrays."""
    at = lambda end, name: cells.select(F.col("node").alias(end), F.col("cell").alias(name))
    met = edges.join(at("src", "cell"), "src").join(at("dst", "to"), "dst")
    every = [*columns, "to"]
    rows = met.groupBy("cell").agg(F.collect_list(F.struct(*every)).alias("e"))
    return graph.cut(rows.select("cell", *[F.col(f"e.{c}").alias(c) for c in every]))


def regions(edges: DataFrame, home: DataFrame, columns: list[str]) -> DataFrame:
    """The edges that lead into each region: cell, src, dst, ``columns`` and inside, whether they also begin there.

    The region of a cell of ``home`` (node, cell) is the cell and those that most edges join to it, at most ``AROUND``.
    """
    at = lambda end, name: home.select(F.col("node").alias(end), F.col("cell").alias(name))
    met = graph.cut(edges.select("src", "dst", *columns).filter("src <> dst").join(at("src", "_a"), "src").join(at("dst", "_b"), "dst"))
    over = met.filter("_a <> _b").groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    pairs = over.union(over.select("_b", "_a", "n")).groupBy(F.col("_a").alias("cell"), F.col("_b").alias("part")).agg(F.sum("n").alias("n"))
    nearest = pairs.selectExpr("cell", "part", "row_number() over (partition by cell order by n desc, part) as _r").filter(F.col("_r") <= AROUND)
    own = home.select("cell", F.col("cell").alias("part")).distinct()
    parts = graph.cut(own.union(nearest.select("cell", "part")))
    rows = met.join(parts.withColumnRenamed("part", "_b"), "_b").join(parts.select("cell", F.col("part").alias("_a"), F.lit(True).alias("_in")), ["cell", "_a"], "left")
    return graph.cut(rows.select("cell", "src", "dst", *columns, F.col("_in").isNotNull().alias("inside")))


def profiles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with ``profile`` in place of ``_v``, and profile, _v: each distinct list of speeds once."""
    lists = graph.cut(edges.select("_v").distinct().withColumn("profile", F.monotonically_increasing_id()))
    return edges.join(lists, "_v").drop("_v"), lists


def nodes_of_timed_cells(lists: DataFrame, n_nodes: int) -> int:
    """How many nodes a cell has at most, so that its speed profiles are about ``PROFILE_VALUES`` numbers at most."""
    values = lists.agg(F.sum(F.size("_v"))).first()[0] or 0
    return CELL_NODES if values <= PROFILE_VALUES else max(1, min(CELL_NODES, PROFILE_VALUES * n_nodes // values))


def timed(have: DataFrame, lists: DataFrame, slot: float) -> DataFrame:
    """``have`` (as ``packed`` makes it) with each profile of a cell's edges once: p_id, p_size, and p_v and p_c, their speeds and sums one after another."""
    known = lists.withColumn("_c", geo.profile_cumsum(F.col("_v"), slot))
    used = have.select("cell", F.explode(F.array_distinct("profile")).alias("profile"))
    rows = used.join(known, "profile").groupBy("cell").agg(F.collect_list(F.struct("profile", "_v", "_c")).alias("p"))
    flat = rows.select("cell", F.col("p.profile").alias("p_id"), F.transform("p", lambda x: F.size(x["_v"])).alias("p_size"), F.flatten("p._v").alias("p_v"), F.flatten("p._c").alias("p_c"))
    return graph.cut(have.join(flat, "cell", "left"))


def guided(have: DataFrame, tables: DataFrame) -> DataFrame:
    """``have`` (as ``packed`` makes it) with the landmark distances of every node its edges touch.

    ``tables``: node, d_from, d_to, arrays by landmark position. Adds h_node, and h_from and h_to, the
    arrays of all these nodes one after another; a cell and its border are bounded, so are these.
    """
    touched = have.select("cell", F.explode(F.array_distinct(F.concat("src", "dst"))).alias("node"))
    unknown = lambda c: F.transform(c, lambda x: F.lit(None).cast("double"))
    known = tables.select("node", F.coalesce("d_from", unknown("d_to")).alias("d_from"), F.coalesce("d_to", unknown("d_from")).alias("d_to"))
    rows = touched.join(known, "node").groupBy("cell").agg(F.collect_list(F.struct("node", "d_from", "d_to")).alias("h"))
    flat = rows.select("cell", F.col("h.node").alias("h_node"), F.flatten("h.d_from").alias("h_from"), F.flatten("h.d_to").alias("h_to"))
    return graph.cut(have.join(flat, "cell", "left"))


def _landmarks(cell: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Nodes of a cell and their landmark distances from and to, NaN where there is no way."""
    if not cell.num_rows or "h_node" not in cell.column_names or not (nodes := _lists(cell, "h_node")):
        return None
    return nodes, *(np.array(_lists(cell, c), dtype=float).reshape(len(nodes), -1) for c in ("h_from", "h_to"))


def _still(marks: tuple[list[int], np.ndarray, np.ndarray], t_from: list, t_to: list) -> dict[int, float]:
    """node to a bound that its distance to the target cannot fall below, safe against rounding."""
    nodes, h_from, h_to = marks
    t_from, t_to = np.array(t_from, dtype=float), np.array(t_to, dtype=float)
    gaps = np.concatenate([h_to - t_to - SLACK * (h_to + t_to), t_from - h_from - SLACK * (t_from + h_from)], axis=1)
    return dict(zip(nodes, np.fmax.reduce(gaps, axis=1, initial=0.0).tolist()))


def _array(table: pa.Table, name: str) -> np.ndarray:
    """The values of the only row of a column of arrays of numbers."""
    return table.column(name)[0].values.to_numpy(zero_copy_only=False)


def _lists(table: pa.Table, name: str) -> list:
    """The values of the only row of a column of arrays."""
    return table.column(name)[0].as_py()


def arrival(t: float, length: float, speeds: list[float], cum: list[float], slot: float) -> float:
    """``functions.geo.arrival_time`` of one edge."""
    k = min(int(t // slot), len(cum) - 1)
    target = cum[k] + speeds[k] * (t - k * slot) + length
    k = bisect_right(cum, target) - 1
    return k * slot + (target - cum[k]) / speeds[k]


class Ways:
    """The edges of a cell by their source: (dst, cell of dst, cost before to cost after, road type, valid from, valid to).

    Those of a node are made when a search first comes to it; most searches see few nodes of a cell.
    """

    def __init__(self, cell: pa.Table, weight: str, by_clock: bool, slot: float, dated: bool):
        self.met: dict[int, list[tuple]] = {}
        self.spans: dict[int, tuple[int, int]] = {}
        self.weight, self.slot = ("length" if by_clock else weight), slot
        if not cell.num_rows:
            return
        src = _array(cell, "src")
        order = np.argsort(src, kind="stable")
        src = src[order]
        names = ["dst", "to", self.weight, *(("valid_from", "valid_to") if dated else ()), *(("profile",) if by_clock else ())]
        self.columns = {c: _array(cell, c)[order] for c in names}
        if "road_type" in cell.column_names:
            coded = cell.column("road_type")[0].values.dictionary_encode()
            self.columns["kind"] = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)[order]
            self.kinds = [*coded.dictionary.to_pylist(), None]
        starts = np.flatnonzero(np.concatenate([src[:1] == src[:1], src[1:] != src[:-1]])).tolist()
        self.spans = dict(zip(src[starts].tolist(), zip(starts, [*starts[1:], len(src)])))
        self.speeds: dict[int, tuple[list, list]] = {}
        if by_clock:
            ends = np.cumsum(_array(cell, "p_size")).tolist()
            self.profiles = dict(zip(_lists(cell, "p_id"), zip([0, *ends], ends)))
            self.v, self.c = _array(cell, "p_v"), _array(cell, "p_c")

    def _clock(self, profile: int) -> tuple[list, list]:
        if profile not in self.speeds:
            a, b = self.profiles[profile]
            self.speeds[profile] = self.v[a:b].tolist(), self.c[a:b].tolist()
        return self.speeds[profile]

    def get(self, node: int, default: tuple = ()) -> list[tuple] | tuple:
        if node in self.met:
            return self.met[node]
        if node not in self.spans:
            return default
        a, b = self.spans[node]
        own = {c: x[a:b].tolist() for c, x in self.columns.items()}
        none = [None] * (b - a)
        if "profile" in own:
            ways = [(lambda t, m=m, vc=self._clock(p): arrival(t, m, *vc, self.slot)) for m, p in zip(own["length"], own["profile"])]
        else:
            ways = [w.__add__ for w in own[self.weight]]
        kinds = [self.kinds[k] for k in own["kind"]] if "kind" in own else none
        self.met[node] = list(zip(own["dst"], own["to"], ways, kinds, own.get("valid_from", none), own.get("valid_to", none)))
        return self.met[node]

    def outside(self, own: int) -> dict[int, int]:
        """The nodes of other cells that edges lead to, with their cells."""
        if not self.spans:
            return {}
        away = self.columns["to"] != own
        return dict(zip(self.columns["dst"][away].tolist(), self.columns["to"][away].tolist()))


def follow(entries: list[tuple[float, tuple]], out: dict[int, list[tuple]] | Ways, own: int, free: Callable[[int, tuple], bool] | None, target: int | None, best: float | None, with_path: bool, still: dict[int, float] | None = None, away: dict[int, int] | None = None) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """Labels settled inside a cell from its entries, and the best label for each node that ways out lead to.

    A label is (cost, path), or (cost, (node,)) without paths. They are settled in
    order of cost, then path, so the first of a node is its smallest; a step that costs nothing does not
    return to the path. Nothing beyond ``best`` or the target's cost is followed; ``still`` holds
    what a node's way to the target costs at least, and counts towards it. With ``away``, a node neither there nor in ``still`` has no way.
    """
    heap, settled, leave, seen = list(entries), {}, {}, {}
    led = away is not None and still is not None
    still = still or {}
    least = (lambda node: still.get(node, 0.0 if node in away else np.inf)) if led else (lambda node: still.get(node, 0.0))
    bounded = led or bool(still)
    far = lambda cost, node: best is not None and cost + least(node) > best * (1 + SLACK)
    heapq.heapify(heap)
    while heap:
        label = heapq.heappop(heap)
        cost, path = label
        node = path[-1]
        if node in settled:
            continue
        if best is not None and cost > best:
            break
        if bounded and far(cost, node):
            continue
        settled[node] = label
        if node == target:
            best = cost
            continue
        for edge in out.get(node, ()):
            dst = edge[0]
            if dst in settled or (free and not free(node, edge)):
                continue
            after = edge[2](cost)
            if (best is not None and after > best) or (bounded and far(after, dst)) or (after == cost and dst in path):
                continue
            kept = leave if edge[1] != own else seen
            old = kept.get(dst)
            if old is not None and old[0] < after:
                continue
            new = (after, (*path, dst) if with_path else (dst,))
            if old is None or new < old:
                kept[dst] = new
                if kept is seen:
                    heapq.heappush(heap, new)
    return settled, leave


class Sweep:
    """The edges of a cell as arrays: many searches are followed side by side where costs are asked for, not paths.

    ``nodes`` are those of the cell that edges touch or that are ``entered``, ``away`` those of other cells.
    ``back`` turns the edges inside the cell round and leaves the others out.
    """

    def __init__(self, cell: pa.Table, own: int, weight: str, dated: bool, entered: np.ndarray, back: bool = False):
        names = ["src", "dst", "to", weight, *(("valid_from", "valid_to") if dated else ())]
        edged = bool(cell.num_rows and cell.column("src")[0].is_valid)
        have = {c: _array(cell, c) if edged else np.zeros(0, float if c == weight else np.int64) for c in names}
        inside = have["to"] == own
        self.nodes = np.unique(np.concatenate([have["src"], have["dst"][inside], entered]))
        there = np.flatnonzero(~inside)
        self.away, place = np.unique(have["dst"][there], return_inverse=True)
        self.away_cell = np.zeros(len(self.away), np.int64)
        self.away_cell[place] = have["to"][there]
        at = lambda c: np.searchsorted(self.nodes, have[c])
        src, span = at("src"), lambda rows: [have[c][rows][:, None] for c in names[4:]]
        rows = np.flatnonzero(inside)
        tail, head = (np.searchsorted(self.nodes, have["dst"][rows]), src[rows]) if back else (src[rows], np.searchsorted(self.nodes, have["dst"][rows]))
        by_tail = np.argsort(tail, kind="stable")
        self.head, self.cost, self.span = head[by_tail], have[weight][rows][by_tail], span(rows[by_tail])
        self.first = np.searchsorted(tail[by_tail], np.arange(len(self.nodes) + 1))
        order = np.argsort(place, kind="stable")
        self.out_src, self.out_cost, self.out_span = src[there][order], have[weight][there][order], span(there[order])
        self.out_first = np.searchsorted(place[order], np.arange(len(self.away)))
        self.step = 2.0 * float(self.cost.mean()) if len(self.cost) else 0.0
        self.back, self.kinds = back, []
        if edged and "road_type" in cell.column_names:
            coded = cell.column("road_type")[0].values.dictionary_encode()
            kind = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            self.kinds = [*coded.dictionary.to_pylist(), None]
            self.kind, self.out_kind = kind[rows][by_tail], kind[there][order]

    def barred(self, nodes: list | None, types: list | None, steps: list | None) -> Barred | None:
        """What each search (column) may not use, from its lists of forbidden nodes, road types and steps; none where all are empty."""
        if not any(any(x) for x in (nodes, types, steps) if x):
            return None
        return Barred(self, nodes, types, steps)

    @staticmethod
    def _near(cost: np.ndarray, limit: np.ndarray, still: np.ndarray | None) -> np.ndarray:
        near = cost <= limit
        return near if still is None else near & (cost + still <= limit * (1 + SLACK))

    @staticmethod
    def _steps(cost: np.ndarray, along: np.ndarray, span: list[np.ndarray], rows: np.ndarray | slice, seq: np.ndarray | None) -> np.ndarray:
        after = cost + along[:, None]
        if span and seq is not None:
            after[(span[0][rows] > seq) | (seq >= span[1][rows])] = np.inf
        return after

    def inside(self, d: np.ndarray, limit: np.ndarray, still: np.ndarray | None = None, goals: list[tuple[np.ndarray, int]] | None = None, seq: np.ndarray | None = None, bar: Barred | None = None, more: float = 0.0) -> np.ndarray:
        """Least cost of each node (row) and search (column) from those of the entries in ``d``; infinite beyond ``limit``.

        Labels are followed that lie within a step of the least open one of their search. A
        sum runs along its path as in ``follow``, so the least is the same. ``goals``: for each search nodes
        (rows) and k; the k-th cost of these, and ``more`` of it, lowers ``limit``, in place.
        """
        n = len(self.nodes)
        cost = np.where(self._near(d, limit, still), d, np.inf).T.ravel()
        ahead = None if still is None else np.ascontiguousarray(still.T).ravel()
        act = np.flatnonzero(np.isfinite(cost))
        open_, place = np.zeros(len(cost), bool), np.zeros(len(cost), np.int64)
        open_[act] = True
        near = lambda x, j, at: self._near(x, limit[j], None if ahead is None else ahead[at])
        bound = [(j, j * n + rows, k) for j, (rows, k) in enumerate(goals or ()) if 0 < k <= len(rows)]
        lone = [(j, int(rows[0])) for j, rows, k in bound if len(rows) == 1]
        lone_j, lone_at = np.array([j for j, _ in lone], np.int64), np.array([at for _, at in lone], np.int64)
        bound = [b for b in bound if len(b[1]) > 1]
        turn = 0
        while len(act):
            if lone:
                limit[lone_j] = np.minimum(limit[lone_j], cost[lone_at] * (1 + more))
            if bound and turn % 8 == 0:
                for j, rows, k in bound:
                    limit[j] = min(limit[j], np.partition(cost[rows], k - 1)[k - 1] * (1 + more))
            turn += 1
            own, j = cost[act], act // n
            least = np.full(len(limit), np.inf)
            np.minimum.at(least, j, own)
            now = own <= least[j] + self.step
            rows, act = act[now], act[~now]
            open_[rows] = False
            rows = rows[near(own[now], j[now], rows)]
            node = rows % n
            counts = self.first[node + 1] - self.first[node]
            edge = np.repeat(self.first[node] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            tail = np.repeat(rows, counts)
            to, new = self.head[edge] + (tail - tail % n), cost[tail] + self.cost[edge]
            good = new < cost[to]
            edge, to, new = edge[good], to[good], new[good]
            j = to // n
            good = near(new, j, to)
            if self.span and seq is not None:
                good &= (self.span[0][edge, 0] <= seq[j]) & (seq[j] < self.span[1][edge, 0])
            if bar is not None:
                good &= ~bar.inside(edge, j, to)
            to, new = to[good], new[good]
            np.minimum.at(cost, to, new)
            to = to[~open_[to]]
            place[to] = np.arange(len(to))
            to = to[place[to] == np.arange(len(to))]
            open_[to] = True
            act = np.concatenate([act, to])
        d = cost.reshape(-1, n).T
        return np.where(self._near(d, limit, still), d, np.inf)

    def leave(self, d: np.ndarray, limit: np.ndarray, still: np.ndarray | None = None, seq: np.ndarray | None = None, bar: Barred | None = None) -> np.ndarray:
        """Least cost of each node of ``away`` (row) and search, infinite beyond ``limit``."""
        if not len(self.away):
            return np.zeros((0, d.shape[1]))
        new = self._steps(d[self.out_src], self.out_cost, self.out_span, slice(None), seq)
        if bar is not None:
            bar.outside(new)
        new = np.minimum.reduceat(new, self.out_first, axis=0)
        return np.where(self._near(new, limit, still), new, np.inf)

    def known(self, marks: tuple[list[int], np.ndarray, np.ndarray], t_from: list, t_to: list) -> np.ndarray:
        """What each of ``nodes``, then of ``away``, costs at least to the target; 0 where nothing is known."""
        told = _still(marks, t_from, t_to)
        return np.array([told.get(n, 0.0) for n in (*self.nodes.tolist(), *self.away.tolist())])


class Barred:
    """Forbidden nodes, road types and steps of the searches (columns) of a sweep."""

    def __init__(self, plane: Sweep, nodes: list | None, types: list | None, steps: list | None):
        self.plane = plane
        n, columns = len(plane.nodes), range(len(nodes or types or steps))
        self.spots = self.kinds = self.edges = None
        self.away: list[tuple[int, np.ndarray]] = []
        if nodes and any(nodes):
            self.spots = np.zeros(n * len(columns), bool)
            for j in columns:
                ids = np.array(nodes[j] or [], np.int64)
                at = np.minimum(np.searchsorted(plane.nodes, ids), n - 1)
                self.spots[j * n + at[plane.nodes[at] == ids]] = True
                if nodes[j] and len(plane.away):
                    self.away.append((j, np.isin(plane.away, np.array(nodes[j], np.int64))))
        if types and any(types) and plane.kinds:
            self.kinds = np.array([[k in set(types[j] or ()) for k in plane.kinds] for j in columns])
        self.out_edges: list[tuple[np.ndarray, int]] = []
        if steps and any(steps):
            found: list[np.ndarray] = []
            for j in columns:
                for e in steps[j] or ():
                    u, v = (e["v"], e["u"]) if plane.back else (e["u"], e["v"])
                    i, k = int(np.searchsorted(plane.nodes, u)), int(np.searchsorted(plane.nodes, v))
                    if i >= n or plane.nodes[i] != u:
                        continue
                    if k < n and plane.nodes[k] == v:
                        a, b = plane.first[i], plane.first[i + 1]
                        found.append(j * len(plane.head) + a + np.flatnonzero(plane.head[a:b] == k))
                    if len(plane.away) and (m := int(np.searchsorted(plane.away, v))) < len(plane.away) and plane.away[m] == v:
                        a, b = plane.out_first[m], plane.out_first[m + 1] if m + 1 < len(plane.away) else len(plane.out_src)
                        self.out_edges.append((a + np.flatnonzero(plane.out_src[a:b] == i), j))
            self.edges = np.unique(np.concatenate(found)) if found else None

    def inside(self, edge: np.ndarray, j: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Which steps along ``edge`` of searches ``j`` to the places ``to`` are forbidden."""
        out = np.zeros(len(edge), bool) if self.spots is None else self.spots[to]
        if self.kinds is not None:
            out = out | self.kinds[j, self.plane.kind[edge]]
        if self.edges is not None and len(edge):
            key = j * len(self.plane.head) + edge
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            out = out | (self.edges[at] == key)
        return out

    def outside(self, after: np.ndarray) -> None:
        """Makes costs behind forbidden ways out infinite, in place: a row for each, a column for each search."""
        if self.kinds is not None:
            after[self.kinds[:, self.plane.out_kind].T] = np.inf
        for j, shut in self.away:
            sizes = np.diff(np.append(self.plane.out_first, len(self.plane.out_src)))
            after[np.repeat(shut, sizes), j] = np.inf
        for rows, j in self.out_edges:
            after[rows, j] = np.inf


def _numbers(table: pa.Table, name: str, other: float = np.inf) -> np.ndarray:
    """A column as doubles, ``other`` where it is null or not there."""
    if name not in table.column_names:
        return np.full(table.num_rows, other)
    return np.array([other if x is None else x for x in table.column(name).to_pylist()], dtype=float)


def swept(work: pa.Table, cell: pa.Table, weight: str, dated: bool, whole: bool, at_once: bool = False) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``follow`` finds for all searches of a unit, without paths: search_id, way, node, cell and cost, as arrays."""
    own = work.column("cell")[0].as_py()
    searches, first, col = np.unique(work.column("search_id").to_numpy(), return_index=True, return_inverse=True)
    node, cost = work.column("node").to_numpy(), work.column("cost").to_numpy()
    plane, one = Sweep(cell, own, weight, dated, node), work.take(pa.array(first))
    at, marks, best = np.searchsorted(plane.nodes, node), _landmarks(cell), _numbers(one, "_best")
    ask = lambda c: one.column(c).to_pylist() if c in one.column_names else None
    target, group, k, t_from, t_to, seqs = (ask(c) for c in ("target", "group", "k", "t_from", "t_to", "seq"))
    shut = [ask(c) for c in FORBIDDEN]
    wanted: dict[object, list[int]] = {}
    if group and cell.num_rows and "w_node" in cell.column_names and (there := _lists(cell, "w_node")):
        spot = np.searchsorted(plane.nodes, there)
        found = plane.nodes[np.minimum(spot, len(plane.nodes) - 1)] == np.array(there)
        for g, i, ok in zip(_lists(cell, "w_group"), spot.tolist(), found.tolist()):
            if ok:
                wanted.setdefault(g, []).append(i)
    by = np.argsort(col, kind="stable")
    ends = np.searchsorted(col[by], np.arange(len(searches) + 1))
    n, rest = len(plane.nodes), np.zeros(0, np.int64)
    for lo in range(0, len(searches), SIDE):
        cols = range(lo, min(lo + SIDE, len(searches)))
        rows = by[ends[lo] : ends[cols[-1] + 1]]
        d = np.full((n, len(cols)), np.inf)
        d[at[rows], col[rows] - lo] = cost[rows]
        still = None
        if marks and t_from and any(t_from[j] for j in cols):
            still = np.stack([plane.known(marks, t_from[j], t_to[j]) if t_from[j] else np.zeros(n + len(plane.away)) for j in cols], axis=1)
        goals = None
        if group:
            goals = [(np.array(wanted.get(group[j], rest), np.int64), int(k[j])) for j in cols]
        elif target:
            spots = [np.flatnonzero(plane.nodes == target[j]) if target[j] is not None else rest for j in cols]
            goals = [(s, 1) for s in spots]
        seq = np.array([seqs[j] for j in cols], np.int64) if dated and seqs else None
        bar = plane.barred(*(x and [x[j] for j in cols] for x in shut))
        limit = best[lo : cols[-1] + 1].copy()
        d = plane.inside(d, limit, None if still is None else still[:n], None if whole else goals, seq, bar)
        told = [np.array(searches[lo : cols[-1] + 1])]

        def tell(way: int, ids: np.ndarray, to: np.ndarray, x: np.ndarray) -> tuple:
            i, j = np.nonzero(np.isfinite(x))
            return told[0][j], way, ids[i], to[i], x[i, j]

        if whole or at_once:
            yield tell(2, plane.nodes, np.full(n, own), d)
        if whole:
            continue
        yield tell(0, plane.away, plane.away_cell, plane.leave(d, limit, None if still is None else still[n:], seq, bar))
        if goals:
            only = np.full_like(d, np.inf)
            for j, (spot, _) in enumerate(goals):
                only[spot, j] = d[spot, j]
            yield tell(1, plane.nodes, np.full(n, own), only)


def rests(work: pa.Table, cell: pa.Table, weight: str, dated: bool) -> dict[int, dict[int, float]]:
    """For each search of a unit, what every node of the cell from which its target can be reached within its bound costs to it, from the entries b_node, b_cost of the search from the target."""
    own = work.column("cell")[0].as_py()
    searches, first = np.unique(work.column("search_id").to_numpy(), return_index=True)
    one = work.take(pa.array(first))
    nodes, costs = one.column("b_node").to_pylist(), one.column("b_cost").to_pylist()
    plane = Sweep(cell, own, weight, dated, np.concatenate([work.column("node").to_numpy(), *[np.array(x or [], np.int64) for x in nodes]]), back=True)
    out, most = {}, _numbers(one, "_best")
    seqs = one.column("seq").to_pylist() if dated else None
    shut = [one.column(c).to_pylist() if c in one.column_names else None for c in FORBIDDEN]
    for lo in range(0, len(searches), SIDE):
        cols = range(lo, min(lo + SIDE, len(searches)))
        d = np.full((len(plane.nodes), len(cols)), np.inf)
        for j in cols:
            d[np.searchsorted(plane.nodes, np.array(nodes[j] or [], np.int64)), j - lo] = costs[j] or []
        bar = plane.barred(*(x and [x[j] for j in cols] for x in shut))
        d = plane.inside(d, most[lo : cols[-1] + 1] * (1 + SLACK), seq=np.array([seqs[j] for j in cols], np.int64) if seqs else None, bar=bar)
        for j in cols:
            there = np.flatnonzero(np.isfinite(d[:, j - lo]))
            out[int(searches[j])] = dict(zip(plane.nodes[there].tolist(), d[there, j - lo].tolist()))
    return out


def closed(near: DataFrame, home: DataFrame, asked: DataFrame, limits: list[str], weight: str) -> DataFrame:
    """search_id, node, cost, path (null: no way) of those searches of ``asked`` that no way out of the region around their target can better.

    ``near``: ``regions`` of ``home``. Costs are followed from the target on, many searches side by side, until the source is reached;
    where every way into the region already costs more than that (or than ``most``), all best ways lie within, and
    the path is followed along them. What is found is what ``rounds`` finds; other searches have no row.
    """
    dated = "valid_from" in near.columns and "seq" in limits
    schema = "search_id long, node long, cost double, path array<long>"

    def run(work: pa.Table, cell: pa.Table) -> pa.Table:
        made: list[tuple[int, int, float | None, list | None]] = []
        if work.num_rows:
            made = list(_closed(work, cell, weight, dated))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.table({c: pa.array([m[i] for m in made], t) for i, (c, t) in enumerate(zip(("search_id", "node", "cost", "path"), types))})

    columns = ["search_id", "source", "target", *limits, *(c for c in ("most",) if c in asked.columns)]
    work = graph.cut(asked.select(*columns).join(home.select(F.col("node").alias("target"), "cell"), "target"))
    units = work.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(UNIT * SWEPT)).cast("int").alias("units"))
    shared = work.join(units, "cell").withColumn("unit", F.pmod(F.xxhash64("search_id"), F.col("units")).cast("int")).drop("units")
    open_ = near.join(units, "cell").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).drop("units")
    return graph.cut(shared.groupBy("cell", "unit").cogroup(open_.groupBy("cell", "unit")).applyInArrow(run, schema))


def _closed(work: pa.Table, cell: pa.Table, weight: str, dated: bool) -> Iterator[tuple[int, int, float | None, list | None]]:
    """The rows of ``closed`` for a unit of searches and the edges into their region."""
    ends = pa.array([0, cell.num_rows], pa.int32())
    own = {c: pa.ListArray.from_arrays(ends, pa.concat_arrays(cell.column(c).chunks) if cell.num_rows else pa.array([], cell.schema.field(c).type)) for c in cell.column_names if c not in ("cell", "unit")}
    inside = own.pop("inside").values.to_numpy(zero_copy_only=False).astype(bool)
    listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x, pa.int64()))
    here = np.zeros(len(inside), np.int64)
    out = Ways(pa.table({**own, "to": listed(here)}), weight, False, geo.SLOT_WIDTH, dated)
    source, target = work.column("source").to_numpy(), work.column("target").to_numpy()
    back = pa.table({**own, "src": own["dst"], "dst": own["src"], "to": listed(np.where(inside, 0, 1))})
    plane = Sweep(back, 0, weight, dated, np.concatenate([source, target]))
    ask = lambda c: work.column(c).to_pylist() if c in work.column_names else None
    nodes, types, steps = (ask(c) for c in FORBIDDEN)
    turned = steps and [[{"u": e["v"], "v": e["u"]} for e in x or ()] for x in steps]
    search, seqs, most = work.column("search_id").to_pylist(), ask("seq") if dated else None, _numbers(work, "most")
    first, last = np.searchsorted(plane.nodes, source), np.searchsorted(plane.nodes, target)
    for lo in range(0, len(search), SIDE):
        cols = range(lo, min(lo + SIDE, len(search)))
        d = np.full((len(plane.nodes), len(cols)), np.inf)
        d[last[lo : cols[-1] + 1], np.arange(len(cols))] = 0.0
        limit = most[lo : cols[-1] + 1] * (1 + SLACK)
        seq = np.array([seqs[j] for j in cols], np.int64) if seqs else None
        bar = plane.barred(*(x and [x[j] for j in cols] for x in (nodes, types, turned)))
        d = plane.inside(d, limit, goals=[(first[j : j + 1], 1) for j in cols], seq=seq, bar=bar, more=3 * SLACK)
        shut = ~np.isfinite(plane.leave(d, limit, seq=seq, bar=bar)).any(axis=0)
        for j in cols:
            if not shut[j - lo]:
                continue
            least = d[first[j], j - lo]
            if not np.isfinite(least):
                yield search[j], int(target[j]), None, None
                continue
            there = np.flatnonzero(np.isfinite(d[:, j - lo]))
            still = dict(zip(plane.nodes[there].tolist(), d[there, j - lo].tolist()))
            barred, kinds = set(nodes[j] or () if nodes else ()), set(types[j] or () if types else ())
            taken, at = {(e["u"], e["v"]) for e in (steps[j] or () if steps else ())}, seqs and seqs[j]

            def free(src: int, edge: tuple) -> bool:
                if edge[0] in barred or edge[3] in kinds or (src, edge[0]) in taken:
                    return False
                return not dated or edge[4] <= at < edge[5]

            best = min(float(least) * (1 + SLACK), float(most[j]))
            settled, _ = follow([(0.0, (int(source[j]),))], out, 0, free if dated or barred or kinds or taken else None, int(target[j]), best, True, still, {})
            cost, path = settled.get(int(target[j]), (None, None))
            yield search[j], int(target[j]), cost, path and list(path)


def rounds(edges: DataFrame, cells: DataFrame, done: DataFrame, asked: DataFrame, limits: list[str], weight: str, with_path: bool, slot: float, stop: DataFrame | None, merge: int, have: DataFrame | None = None, lists: DataFrame | None = None, rest: DataFrame | None = None, entered_too: bool = False, at_once: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """search_id, node, cost[, path] of the searches of ``asked``, from the labels ``done`` of their sources.

    ``edges``: src, dst, what ``weight`` needs and what ``limits`` (constraint columns of ``asked``) look at.
    For weight ``time`` the edges name their ``profile`` among ``lists`` (see ``profiles``).
    With a target only its label is among the result; with ``stop`` (node, group) and k, the places met
    until the k-th (with paths or times other nodes too); else all nodes. Where ``asked`` has ``most`` (null: none), no label of a search costs more. ``have``: the edges as ``packed`` made them for an earlier call,
    or ``guided``; then columns t_from and t_to of ``asked`` (landmark distances of the target; null: no bound) leave out labels that cannot be part of a best path.
    ``rest`` (goal, cell, b_node, b_cost: entries of the search from each goal on reversed edges) leaves out all nodes that are not on a best way, of searches with a path and a ``goal``.
    Costs without paths, of lengths or mean times, are found for many searches side by side (``Sweep``). ``entered_too``: also gives the entries: search_id, node, cell, cost.
    ``at_once``, for few searches over the whole graph: each round writes all nodes of its cells, so that no round of its own does at the end, and a cell is one unit.
    """
    by_clock = weight == "time"
    columns = [c for c in edges.columns if c not in ("src", "dst")]
    have = packed(edges, cells, ["src", "dst", *columns]) if have is None else have
    have = timed(have, lists, slot) if by_clock else have
    dated = "valid_from" in columns and "seq" in limits
    target, every = "target" in asked.columns, stop is not None
    to_goals = rest is not None
    side = not with_path and not by_clock
    at_once = at_once and side and not target and not every and not limits
    if side and every:
        # a cell without edges out may hold places
        there = stop.select("node", "group").distinct().join(cells, "node").groupBy("cell").agg(F.collect_list(F.struct("node", "group")).alias("w"))
        have = graph.cut(have.join(there.select("cell", F.col("w.node").alias("w_node"), F.col("w.group").alias("w_group")), "cell", "full"))
    kind = ["cost", "path"] if with_path else ["cost"]
    path = ", path array<long>" if with_path else ""
    schema = f"search_id long, way int, node long, cell long, cost double{path}"
    number = dict(done.dtypes)["search_id"]

    def worker(whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(work: pa.Table, cell: pa.Table) -> pa.Table:
            made: dict[str, list] = {"search_id": [], "way": [], "node": [], "cell": [], "cost": [], **({"path": []} if with_path else {})}
            types_ = {"search_id": pa.int64(), "way": pa.int32(), "node": pa.int64(), "cell": pa.int64(), "cost": pa.float64(), **({"path": pa.list_(pa.int64())} if with_path else {})}
            if side:
                told = list(swept(work, cell, weight, dated, whole, at_once)) if work.num_rows else []
                joined = lambda i, kind: np.concatenate([np.zeros(0, kind), *[np.full(len(t[0]), t[1], np.int32) if i == 1 else t[i] for t in told]]).astype(kind)
                return pa.table({c: pa.array(joined(i, float if c == "cost" else np.int32 if c == "way" else np.int64), types_[c]) for i, c in enumerate(types_)})
            out = Ways(cell if work.num_rows else cell.slice(0, 0), weight, by_clock, slot, dated)
            marks = _landmarks(cell)
            ahead = rests(work, cell, weight, dated) if to_goals and work.num_rows else {}
            own = work.column("cell")[0].as_py() if work.num_rows else None

            def tell(search: int, way: int, to: int | None, labels: Iterator[tuple[int, tuple]]) -> None:
                for node, (cost, steps) in labels:
                    made["search_id"].append(search)
                    made["way"].append(way)
                    made["node"].append(node)
                    made["cell"].append(to)
                    made["cost"].append(cost)
                    if with_path:
                        made["path"].append(list(steps))

            by: dict[int, list[dict]] = {}
            for row in work.to_pylist():
                by.setdefault(row["search_id"], []).append(row)
            where = out.outside(own)
            for search, rows in by.items():
                one = rows[0]
                nodes, types = set(one.get("forbidden_nodes") or ()), set(one.get("forbidden_road_types") or ())
                steps = {(e["u"], e["v"]) for e in one.get("forbidden_edges") or ()}
                seq = one.get("seq")

                def free(src: int, edge: tuple) -> bool:
                    if edge[0] in nodes or edge[3] in types or (src, edge[0]) in steps:
                        return False
                    return not dated or (seq is not None and edge[4] <= seq < edge[5])

                entries = [(r["cost"], tuple(r["path"]) if with_path else (r["node"],)) for r in rows]
                still = _still(marks, one["t_from"], one["t_to"]) if marks and one.get("t_from") else None
                if to_goals:
                    still = {n: x for n, x in (still or {}).items() if n in where} | ahead.get(search, {})
                settled, leave = follow(entries, out, own, free if dated or nodes or types or steps else None, one.get("target"), one.get("_best"), with_path, still, where if to_goals else None)
                if whole:
                    tell(search, 2, own, settled.items())
                    continue
                for node, label in leave.items():
                    tell(search, 0, where[node], [(node, label)])
                if every:
                    tell(search, 1, own, settled.items())
                elif target and one["target"] in settled:
                    tell(search, 1, own, [(one["target"], settled[one["target"]])])
            return pa.table({c: pa.array(v, types_[c]) for c, v in made.items()})

        return run

    def least(rows: DataFrame, *by: str) -> DataFrame:
        label = rows.groupBy(*by).agg(F.min(F.struct(*kind)).alias("_b"))
        return label.select(*by, *(f"_b.{c}" for c in kind))

    def worked(work: DataFrame, best: DataFrame | None, whole: bool) -> DataFrame:
        """One exchange: entries, in units of bounded size, with the edges of their cells."""
        if at_once:
            return work.withColumn("unit", F.lit(0)).groupBy("cell", "unit").cogroup(have.withColumn("unit", F.lit(0)).groupBy("cell", "unit")).applyInArrow(worker(whole), schema)
        searches = work.select("cell", "search_id").distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        units = searches.select("cell", F.ceil(F.col("n") / F.lit(UNIT * (SWEPT if side or to_goals else 1))).cast("int").alias("units"))
        shared = work.join(units, "cell").withColumn("unit", F.pmod(F.xxhash64("search_id"), F.col("units")).cast("int")).drop("units")
        shared = shared.join(asked.select("search_id", *limits, *(c for c in ("target", "t_from", "t_to", "goal", *(("group", "k") if side else ())) if c in asked.columns)), "search_id")
        shared = shared.join(rest, ["goal", "cell"], "left") if rest is not None else shared
        shared = shared.join(best, "search_id", "left") if best is not None else shared
        open_ = have.join(units, "cell").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).drop("units")
        return shared.groupBy("cell", "unit").cogroup(open_.groupBy("cell", "unit")).applyInArrow(worker(whole), schema)

    front = done.select(F.col("search_id").cast("long"), "node", *kind).join(cells, "node")
    front = graph.cut(front.select("search_id", "node", "cell", *kind))
    cap = asked.filter("most is not null").select("search_id", F.col("most").alias("_best")) if "most" in asked.columns else None
    parts, met, best = [front], [], cap
    while not front.isEmpty():
        entered = graph.together(parts)
        work = entered.join(front.select("search_id", "cell").distinct(), ["search_id", "cell"], "left_semi")
        out = graph.cut(worked(least(work, "search_id", "cell", "node"), best, False))
        if target or every or at_once:
            met.append(out)
            if len(met) > merge:
                met = [graph.cut(least(graph.together(met).filter("way > 0"), "search_id", "way", "node", "cell"))]
        if target or every:
            hits = graph.together(met).filter("way = 1").groupBy("search_id", "node").agg(F.min("cost").alias("cost"))
            if stop is not None:
                hits = hits.join(asked.select("search_id", "group", "k"), "search_id").join(stop.select("node", "group").distinct(), ["node", "group"])
            else:
                hits = hits.withColumn("k", F.lit(1))
            best = hits.selectExpr("search_id", "cost as _best", "k", "row_number() over (partition by search_id order by cost, node) as _r").filter("_r = k").select("search_id", "_best")
            best = best if cap is None else best.unionByName(cap).groupBy("search_id").agg(F.min("_best").alias("_best"))
        tried = least(out.filter("way = 0"), "search_id", "node", "cell")
        old = entered.select(F.col("search_id").alias("_s"), F.col("node").alias("_n"), F.struct(*kind).alias("_old"))
        known = (F.col("search_id") == F.col("_s")) & (F.col("node") == F.col("_n")) & (F.col("_old") <= F.struct(*kind))
        fresh = tried.join(old, known, "left_anti")
        if best is not None:
            fresh = fresh.join(best, "search_id", "left").filter("_best is null or cost <= _best").drop("_best")
        front = graph.cut(fresh.select("search_id", "node", "cell", *kind))
        parts.append(front)
        if len(parts) > merge:
            parts = [graph.cut(least(graph.together(parts), "search_id", "node", "cell").select("search_id", "node", "cell", *kind))]
    if met:
        out = graph.together(met).filter("way > 0")
    else:
        out = graph.cut(worked(least(graph.together(parts), "search_id", "cell", "node"), cap, True))
    found = graph.cut(least(out, "search_id", "node").withColumn("search_id", F.col("search_id").cast(number)))
    return (found, graph.cut(least(graph.together(parts), "search_id", "node", "cell"))) if entered_too else found
