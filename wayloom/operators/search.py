"""Batched shortest-path searches in rounds over the cells of a graph."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import cells, graph, overlay

#: Constraint columns a frame of searches may have.
CONSTRAINTS = ("forbidden_nodes", "forbidden_road_types", "forbidden_edges", "seq")

#: Rounds whose new entries lie in tables of their own before they are merged.
MERGE = 16


def labels(adj: DataFrame, searches: DataFrame, weight: str = "length", with_path: bool = False, depart: float = 0.0, slot_width: float = geo.SLOT_WIDTH, stop: DataFrame | None = None, few: int | None = None, where: DataFrame | None = None, have: DataFrame | None = None, nodes: DataFrame | None = None, rest: DataFrame | None = None, entered_too: bool = False, at_once: bool = False, near: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Best cost of each node that each search reaches: search_id, node, cost[, path].

    ``adj``: src, dst and ``weight``; for ``weight='time'`` length and
    speed_profile, and the cost is the clock on arrival. ``searches``: search_id (an integer),
    source, optionally target and constraint columns. With a target, nothing is
    followed beyond the best cost known for it, and only its label is returned. ``stop`` (node, group) with a
    search column ``k`` and ``group`` ends a search once k nodes of its group have been reached
    at no more cost, and gives the places met (with paths or times other nodes too). A search column ``most`` bounds the cost of all its labels (null: no bound). Ties go to the lexicographically smallest path among those without repeated nodes.

    One plan at every size: nodes lie in cells (``where``: node, cell; made of ``nodes``, or by node ids, if not given), and a
    round crosses a cell (``cells.rounds``). It is exact for weights that are not negative and for arrival times,
    where leaving later never means arriving earlier. Rounds end when nothing improves.
    ``have``: their edges, where ``cells.packed`` or ``cells.guided`` made them before; with the latter, search columns t_from and
    t_to (landmark distances of the target) keep a search from nodes too far off its way. ``few`` is of no use any more and may be left out.
    With ``near``, ``cells.regions`` of ``where``, only the searches that ``cells.closed`` settles have rows.
    ``lists`` (``graph.profile_ids``): the speed profiles, where those of ``adj`` are numbers.
    """
    columns = set(searches.columns)
    if near is not None:
        return cells.closed(near, where, searches, [c for c in CONSTRAINTS if c in columns], weight)
    timed = weight == "time"
    need = ["src", "dst"] + (["length", "profile"] if timed else [weight])
    if timed and lists is not None:
        adj, lists = adj.withColumnRenamed("speed_profile", "profile"), graph.cut(lists.select("profile", geo.profile_speeds(F.col("speed_profile")).alias("_v")))
    elif timed:
        adj, lists = cells.profiles(adj.withColumn("_v", geo.profile_speeds(F.col("speed_profile"))).drop("speed_profile"))
    if "forbidden_road_types" in columns:
        need.append("road_type")
    if "seq" in columns and "valid_from" in adj.columns:
        need += ["valid_from", "valid_to"]
    limits = [c for c in CONSTRAINTS if c in columns]
    if where is None:
        ids = adj.select(F.col("src").alias("id")).union(adj.select("dst")).union(searches.select("source")).distinct() if nodes is None else nodes
        where = cells.assign(ids, cells.nodes_of_timed_cells(lists, ids.count()) if timed else None)
    edges = adj.select(*dict.fromkeys(need)).filter("src <> dst")
    path = [F.array("source").alias("path")] if with_path else []
    asked = searches.select("search_id", *limits, *[c for c in ("target", "k", "group", "most", "t_from", "t_to", "goal") if c in columns]).transform(graph.cut)
    done = searches.select("search_id", F.col("source").alias("node"), F.lit(float(depart)).alias("cost"), *path)
    return cells.rounds(edges, where, done, asked, limits, weight, with_path, slot_width, stop, MERGE, have, lists, rest, entered_too, at_once)


def share(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searches without repeats, and which of them answers each: equal source, target and constraints run once."""
    same = [c for c in ("source", "target", *CONSTRAINTS, "k", "group") if c in searches.columns]
    key = F.sha2(F.to_json(F.struct(*same)), 256)
    keyed = searches.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min("search_id").alias("_run"))
    told = keyed.join(first, "_key")
    runs = told.filter("search_id = _run").drop("_key", "_run").dropDuplicates(["search_id"])
    return runs, told.select("search_id", "_run")


def _guide(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """``runs`` with t_from, t_to (arrays of the target) and most (the best way by a landmark), null where they do not count.

    A constraint only lengthens ways, so the lower bound holds under it; a way by a
    landmark may break it, so ``most`` is for searches without constraints.
    It is that of the columns u_from and u_to of ``tables``, if there.
    """
    u = "u" if "u_from" in tables.columns else "d"
    side = lambda end, mark: tables.select(F.col("node").alias(end), F.col("d_from").alias(f"{mark}_from"), F.col("d_to").alias(f"{mark}_to"), F.col(f"{u}_from").alias(f"{mark}_above_from"), F.col(f"{u}_to").alias(f"{mark}_above_to"))
    at = runs.join(side("source", "s"), "source", "left").join(side("target", "t"), "target", "left")
    counts = F.coalesce("held", F.lit(False)) if "held" in runs.columns else F.lit("seq" not in runs.columns)
    free = counts
    for c in CONSTRAINTS:
        if c in runs.columns and c != "seq":
            free = free & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    upper = F.array_min(F.zip_with("s_above_to", "t_above_from", lambda a, b: a + b)) * F.lit(1 + cells.SLACK)
    return at.select(*runs.columns, *[F.when(counts, F.col(c)).alias(c) for c in ("t_from", "t_to")], F.when(free, upper).alias("most")).transform(graph.cut)


def _ahead(adj: DataFrame, runs: DataFrame, weight: str, where: DataFrame, have: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``runs`` that have a way, with goal and most (its cost), and the entries of the search from each goal: goal, cell, b_node, b_cost.

    One search on reversed edges for each target (and equal constraints) until all its sources are reached, within ``most`` of ``runs`` if there.
    ``have``: the reversed edges, where ``cells.packed`` made them before.
    """
    limits = [c for c in CONSTRAINTS if c in runs.columns]
    keyed = runs.withColumn("_goal", F.sha2(F.to_json(F.struct("target", *limits)), 256))
    most = [F.when(F.count("most") == F.count(F.lit(1)), F.max("most")).alias("most")] if "most" in runs.columns else []
    goals = keyed.groupBy("_goal").agg(F.countDistinct("source").alias("k"), *[F.first(c).alias(c) for c in ("target", *limits)], *most)
    goals = goals.withColumn("goal", F.monotonically_increasing_id()).transform(graph.cut)
    met = keyed.join(goals.select("_goal", "goal"), "_goal").select(*runs.columns, "goal").transform(graph.cut)
    back = adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in adj.columns if c not in ("src", "dst")))
    turned = lambda c: F.transform(c, lambda e: F.struct(e["v"].alias("u"), e["u"].alias("v"))) if c == "forbidden_edges" else F.col(c)
    asked = goals.select(F.col("goal").alias("search_id"), F.col("target").alias("source"), F.col("goal").alias("group"), "k", *[turned(c).alias(c) for c in limits], *[c for c in ("most",) if most])
    found, entered = labels(back, asked, weight, stop=met.select(F.col("source").alias("node"), F.col("goal").alias("group")), where=where, have=have, entered_too=True)
    ways = found.select(F.col("search_id").alias("goal"), F.col("node").alias("source"), (F.col("cost") * F.lit(1 + cells.SLACK)).alias("_way"))
    rest = entered.groupBy(F.col("search_id").alias("goal"), "cell").agg(F.collect_list(F.struct("node", "cost")).alias("b"))
    told = met.join(ways, ["goal", "source"]).withColumn("most", F.least("_way", F.col("most") if most else F.lit(None).cast("double"))).drop("_way")
    return graph.cut(told), graph.cut(rest.select("goal", "cell", F.col("b.node").alias("b_node"), F.col("b.cost").alias("b_cost")))


def both_ways(adj: DataFrame, where: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The edges of cells, ahead and reversed, for several calls of ``best_paths`` over one graph."""
    own = graph.cut(adj.select("src", "dst", *columns).filter("src <> dst"))
    back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns)
    return cells.packed(own, where, ["src", "dst", *columns]), cells.packed(back, where, ["src", "dst", *columns])


class Net:
    """A graph in the forms that searches over it share, each made when first asked for: cells, edges of cells ahead and reversed, and regions.

    Regions are those of ``homes``, frames of cells; if not given, they are made of ``nodes``, in ``cells.HOME_NODES``, and none are made where ``where`` is given.
    """

    def __init__(self, adj: DataFrame, columns: list[str], nodes: DataFrame, where: DataFrame | None = None, homes: list[DataFrame] | None = None):
        self.adj, self.columns, self.nodes, self._where, self._homes = adj, columns, nodes, where, homes
        self._near: dict[int, tuple[DataFrame, DataFrame]] = {}

    @cached_property
    def where(self) -> DataFrame:
        return cells.assign(self.nodes) if self._where is None else self._where

    @cached_property
    def levels(self) -> int:
        return len(self._homes) if self._homes is not None else len(cells.HOME_NODES) if self._where is None else 0

    def near(self, level: int) -> tuple[DataFrame, DataFrame]:
        """Home cells of a level, and the edges into their regions."""
        if level not in self._near:
            home = cells.assign(self.nodes, cells.HOME_NODES[level]) if self._homes is None else self._homes[level]
            self._near[level] = home, cells.regions(self.adj, home, self.columns)
        return self._near[level]

    @cached_property
    def ways(self) -> tuple[DataFrame, DataFrame]:
        return both_ways(self.adj, self.where, self.columns)


def best_paths(net: Net, runs: DataFrame, weight: str, tables: DataFrame | None = None) -> DataFrame:
    """search_id, node, cost, path of the target of each search (search_id, source, target, constraints[, most]) that has a way.

    Searches whose best ways lie within a region end there (``cells.closed``), those left in larger ones. For the others costs are found from the targets on, side by side, then
    paths along best ways only, in rounds over cells. ``tables``, of which ``runs`` have t_from, t_to and most (``_guide``), bound
    all of these, and the nodes of other cells that a way may lead to.
    """
    number, told = dict(runs.dtypes)["search_id"], []
    runs = graph.cut(runs) if net.levels else runs
    for level in range(net.levels):
        home, edges = net.near(level)
        near = labels(net.adj, runs, weight, True, where=home, near=edges)
        told.append(near.filter("path is not null").withColumn("search_id", F.col("search_id").cast(number)))
        runs = graph.cut(runs.join(near.select("search_id"), "search_id", "left_anti"))
        if runs.isEmpty():
            return reduce(DataFrame.unionByName, told)
    ahead, back = net.ways
    runs, rest = _ahead(net.adj, runs, weight, net.where, back)
    ahead = ahead if tables is None else cells.guided(ahead, tables)
    found = labels(net.adj, runs, weight, True, where=net.where, have=ahead, rest=rest).select("search_id", "node", "cost", "path")
    return reduce(DataFrame.unionByName, told, found)


def distances(nodes: DataFrame, adj: DataFrame, searches: DataFrame, tables: DataFrame | None = None, net: overlay.Overlay | None = None) -> DataFrame:
    """search_id, cost of every search that has a way: ``shortest_paths`` of mode ``distance`` for ends anywhere in the graph, without paths.

    Searches without constraints in a large graph meet in tables of border distances (``net``, made here if not given).
    """
    runs, told = share(graph.check_endpoints(searches, nodes).filter("valid").drop("valid"))
    if not set(CONSTRAINTS) & set(runs.columns):
        net = overlay.Overlay(nodes, adj) if net is None else net
        if net.large:
            costs = net.costs(runs.filter("source <> target")).join(runs, ["source", "target"]).select("search_id", "cost")
            costs = costs.union(runs.filter("source = target").select("search_id", F.lit(0.0)))
            return told.join(costs.select(F.col("search_id").alias("_run"), "cost"), "_run").select("search_id", "cost")
    where, have = cells.assign(nodes), None
    if tables is not None:
        runs = _guide(runs, tables)
        columns = [c for c in ("length", "valid_from", "valid_to") if c in adj.columns]
        have = cells.guided(cells.packed(adj.select("src", "dst", *columns).filter("src <> dst"), where, ["src", "dst", *columns]), tables)
    found = labels(adj, runs, where=where, have=have)
    ends = found.join(runs.select("search_id", "target"), "search_id").filter("node = target")
    return told.join(ends.select(F.col("search_id").alias("_run"), "cost"), "_run").select("search_id", "cost")


def shortest_paths(nodes: DataFrame, adj: DataFrame, searches: DataFrame, mode: str = "distance", depart: float = 0.0, slot_width: float = geo.SLOT_WIDTH, few: int | None = None, where: DataFrame | None = None, tables: DataFrame | None = None, far: bool = True, homes: list[DataFrame] | None = None, net: Net | None = None, lists: DataFrame | None = None) -> DataFrame:
    """search_id, possible, cost, path for every search.

    ``mode``: ``distance`` (length), ``time`` (arrival under the speed profiles) or
    ``avg_time`` (mean times). A search with an unknown or forbidden end is not
    possible; a source that is its target costs nothing. Equal searches run once. ``where``: cells of
    the nodes, as ``cells.assign`` makes them. ``few`` is of no use any more.
    ``tables`` (node, d_from, d_to of landmarks; mode ``distance`` only) leave out what cannot be on a best path: see ``_guide``. Answers are the same.
    A search column ``held`` says whether the tables hold for the edges as the search sees them; without it they hold for
    searches without seq, and for none with it, as edges differ from place to place of a log.
    ``far`` (not for mode ``time``): costs are found first, from the targets on and many searches side by side, and paths along best ways only (``best_paths``). Answers are the same.
    ``homes``: cells for the regions in which such searches may end, tried one after another (made of the nodes, if ``where`` is not given). ``net``: the graph in shared forms, for several calls over it. ``lists``: see ``labels``.
    """
    if mode not in ("distance", "time", "avg_time"):
        raise ValueError(f"unknown mode {mode!r}")
    checked = graph.check_endpoints(searches, nodes)
    runs, told = share(checked.filter("valid").drop("valid"))
    weight = {"distance": "length", "time": "time", "avg_time": "edge_time"}[mode]
    if mode == "avg_time":
        adj = adj.withColumn("edge_time", geo.edge_time(F.col("avg_time"), F.col("length")))
    guided = tables is not None and mode == "distance"
    runs = _guide(runs, tables) if guided else runs
    if far and mode != "time":
        limits = {"forbidden_road_types": ["road_type"], "seq": ["valid_from", "valid_to"]}
        columns = [weight, *(x for c, need in limits.items() if c in runs.columns for x in need if x in adj.columns)]
        found = best_paths(Net(adj, columns, nodes, where, homes) if net is None else net, runs, weight, tables if guided else None)
    else:
        have = None
        if guided:
            where = cells.assign(nodes) if where is None else where
            columns = [c for c in ("length", "road_type", "valid_from", "valid_to") if c in adj.columns]
            have = cells.guided(cells.packed(adj.select("src", "dst", *columns).filter("src <> dst"), where, ["src", "dst", *columns]), tables)
        found = labels(adj, runs, weight, True, depart, slot_width, where=where, have=have, nodes=nodes, lists=lists if mode == "time" else None)
    ends = found.join(runs.select(F.col("search_id"), "target"), "search_id").filter("node = target")
    answers = told.join(ends.select(F.col("search_id").alias("_run"), "cost", "path"), "_run")
    out = searches.select("search_id").join(answers.drop("_run"), "search_id", "left")
    return out.select("search_id", F.col("path").isNotNull().alias("possible"), (F.col("cost") - F.lit(float(depart))).alias("cost"), "path")


def sssp(adj: DataFrame, sources: DataFrame, weight: str = "length", where: DataFrame | None = None, have: DataFrame | None = None, at_once: bool = False) -> DataFrame:
    """search_id, node, cost: distances from each source to all it reaches; ``at_once`` where sources are few (``cells.rounds``)."""
    return labels(adj, sources, weight, where=where, have=have, at_once=at_once)
