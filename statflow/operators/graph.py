"""Iterative graph computation on edge DataFrames.

Vertices are non-negative integers. With ``dense`` (the default) every id from 0
to the largest in an edge is a vertex, whether seen or not; else only those seen.
Ids that leave nearly all of that range unseen are refused with ``dense``.
Each pass is one join on a vertex and one partial aggregation. Its state is written
to the shared folder and the one before deleted, so plans stay short, a lost executor
costs one pass. It may be broadcast up to ``BROADCAST_ROWS`` vertices, however well its
file compresses; beyond, it is joined by sorting, in parts of a bounded number of edges,
with hubs split by adaptive execution.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statflow.operators.components import star_components
from statflow.plans.durable import forget, materialize, scratch

#: Ids from 0 on may be this many times the edges before ``dense`` is refused.
DENSITY = 1000
#: A state of more vertices is never broadcast.
BROADCAST_ROWS = 1 << 18


def _edges(edges: DataFrame, s: str, t: str, *more: str) -> DataFrame:
    if missing := [c for c in (s, t, *more) if c not in edges.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    rows = edges.select(F.col(s).cast("long").alias("s"), F.col(t).cast("long").alias("t"), *[F.col(c) for c in more])
    return rows.where("s is not null and t is not null")


def _state(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def vertices(edges: DataFrame, dense: bool = True) -> DataFrame:
    """node: the vertices of edges s, t."""
    if not dense:
        return edges.select(F.col("s").alias("node")).union(edges.select("t")).distinct()
    top, n = edges.agg(F.max(F.greatest("s", "t")), F.count(F.lit(1))).first()
    if top is not None and top > DENSITY * (n + 1000):
        raise ValueError(f"ids up to {top} in {n} edges are sparse: pass dense=False")
    return edges.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("node"))


def page_rank(edges: DataFrame, s: str = "s", t: str = "t", updates: int = 19, damping: float = 0.85, dense: bool = True) -> DataFrame:
    """node, rank: r = (1 - d) + d * sum of r / out-degree over in-edges, from 1, ``updates`` times.
    Not normalised; sinks pass nothing on; parallel edges count each, self-loops as well."""
    raw = materialize(_edges(edges, s, t), "raw")
    size = raw.count()
    # Parallel edges become one row with a share, which also bounds a hub's fan-in per neighbour.
    e = raw.groupBy("s", "t").agg(F.count(F.lit(1)).alias("m"))
    e = e.join(raw.groupBy("s").agg(F.count(F.lit(1)).alias("d")), "s").select("s", "t", (F.col("m") / F.col("d")).alias("share"))
    e = materialize(e, "edges", size)
    nodes = materialize(vertices(raw, dense), "nodes", size)
    n = nodes.count()
    ranks = nodes.select("node", F.lit(1.0).alias("rank"))
    for _ in range(updates):
        old = ranks
        flow = e.join(_state(ranks, n), e.s == ranks.node).groupBy("t").agg(F.sum(F.col("rank") * F.col("share")).alias("x"))
        ranks = nodes.join(flow, nodes.node == flow.t, "left").select("node", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("x", F.lit(0.0))).alias("rank"))
        ranks = materialize(ranks, "ranks", size)
        forget(old)
    return ranks


def connected_components(edges: DataFrame, s: str = "s", t: str = "t", dense: bool = True) -> DataFrame:
    """node, component: the least id reachable, edges taken both ways."""
    raw = _edges(edges, s, t)
    found = star_components(raw.select(F.col("s").alias("u"), F.col("t").alias("v")))
    return vertices(raw, dense).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shortest_path(edges: DataFrame, s: str = "s", t: str = "t", weight: str | None = None, init: str = "init", dense: bool = True, max_iter: int | None = None) -> DataFrame:
    """node, distance: from the sources, edges whose ``init`` says where their first vertex starts;
    unreachable vertices are infinite. Only vertices that just came closer send on. Without a cycle of
    negative weight it ends after as many passes as there are vertices, at most (or ``max_iter``)."""
    raw = materialize(_edges(edges, s, t, init, *([weight] if weight else [])), "raw")
    size = raw.count()
    e = raw.select("s", "t", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(init).cast("double").alias("init"))
    hops = materialize(e.groupBy("s", "t").agg(F.min("w").alias("w")), "edges", size)
    nodes = vertices(raw, dense)
    seeds = e.where(F.col("init").isNotNull() & (F.col("init") < float("inf"))).groupBy("s").agg(F.min("init").alias("d"))
    dist = materialize(nodes.join(seeds, nodes.node == seeds.s, "left").select("node", F.coalesce("d", F.lit(float("inf"))).alias("d"), F.col("d").isNotNull().alias("new")), "distances", size)
    n = dist.count()
    max_iter = max_iter or n + 1
    for _ in range(max_iter):
        front = _state(dist.where("new"), n)
        reach = hops.join(front, hops.s == front.node).groupBy("t").agg(F.min(F.col("d") + F.col("w")).alias("x"))
        old, dist = dist, dist.join(reach, dist.node == reach.t, "left").select("node", F.least("d", F.coalesce("x", "d")).alias("d"), (F.coalesce("x", "d") < F.col("d")).alias("new"))
        dist = materialize(dist, "distances", size)
        forget(old)
        if not dist.where("new").limit(1).count():
            return dist.select("node", F.col("d").alias("distance"))
    raise RuntimeError(f"no fix-point after {max_iter} passes: a cycle of negative weight?")


def strongly_connected_components(edges: DataFrame, s: str = "s", t: str = "t", dense: bool = True) -> DataFrame:
    """node, component: the least id of the strongly connected component, by colouring
    (Orzan 2004): vertices without in- or out-edges are trimmed; every vertex takes the least
    id that reaches it; those that reach their colour back within it form a component. Each round
    finds a component of every colour, so rounds go on until no edge is left; an acyclic
    part takes as many trims as its longest path."""
    raw = materialize(_edges(edges, s, t), "raw")
    size = raw.count()
    spark = edges.sparkSession
    nodes = vertices(raw, dense)
    live = materialize(raw.where("s <> t").distinct(), "live", size)
    n = live.count()
    done: list[DataFrame] = []
    while n:
        before = None
        while n and n != before:  # trim
            before, old = n, live
            kept = live.join(live.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(live.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
            live = materialize(kept.select("s", "t"), "live", n)
            n = live.count()
            forget(old)
        if not n:
            break
        with scratch(spark) as keep:
            points = vertices(live, dense=False)
            colour = pregel(points.withColumn("c", F.col("node")), live, message={"c": F.col("src_c")}, merge={"c": F.min}, combine={"c": F.least(F.col("c"), F.coalesce(F.col("msg_c"), F.col("c")))})
            inside = live.join(colour.select(F.col("node").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("node").alias("t"), F.col("c").alias("ct")), "t").where("cs = ct")
            back = materialize(inside.select(F.col("t").alias("s"), F.col("s").alias("t")), "back", n)
            start = colour.withColumn("hit", F.col("node") == F.col("c"))
            reached = pregel(start, back, message={"hit": F.col("src_hit")}, merge={"hit": F.max}, combine={"hit": F.col("hit") | F.coalesce(F.col("msg_hit"), F.lit(False))})
            found = keep(materialize(reached.where("hit").select("node", F.col("c").alias("component")), "found"))
            done.append(found)
            gone = found.select(F.col("node").alias("x"))
            rest = live.join(gone, live.s == gone.x, "left_anti").join(gone, live.t == gone.x, "left_anti")
            new = keep(materialize(rest, "live", n))
        forget(live)
        live = new
        n = live.count()
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pregel_setup(attributes: DataFrame, key: str, edges: DataFrame | None = None, s: str = "s", t: str = "t", dense: bool = True) -> DataFrame:
    """Vertex table node, attributes...: one row per key, with ``edges`` one per vertex (absent attributes null)."""
    rest = [c for c in attributes.columns if c != key]
    rows = attributes.select(F.col(key).cast("long").alias("node"), *rest).where("node is not null").dropDuplicates(["node"])
    if edges is None:
        return rows
    return vertices(_edges(edges, s, t), dense).join(rows, "node", "full")


def pregel(
    nodes: DataFrame,
    edges: DataFrame,
    message: dict[str, Column],
    merge: dict[str, Callable[[Column], Column]],
    combine: dict[str, Column],
    reverse: dict[str, Column] | None = None,
    where: Column | None = None,
    max_iter: int | None = None,
) -> DataFrame:
    """Vertex program. ``nodes``: node and attributes; ``edges``: s, t and properties.

    Each pass every edge sends ``message`` - expressions over the properties and
    the ends' attributes, as src_x and dst_x - to its target, and ``reverse`` to its
    source; messages to one vertex are merged; ``combine`` gives new attributes from
    the old ones and msg_x. Ends when no attribute changes (or fails after ``max_iter`` passes). ``where`` limits the edges
    that send. Merging must be associative, as partial merges come first.
    """
    attributes = [c for c in nodes.columns if c != "node"]
    if unknown := set(combine) - set(attributes):
        raise ValueError(f"no such attributes: {', '.join(unknown)}")
    if set(message) != set(merge) or reverse is not None and set(reverse) != set(merge):
        raise ValueError("message, reverse and merge need the same names")
    used = " ".join(str(c) for c in [*message.values(), *(reverse or {}).values(), *([where] if where is not None else [])])
    state = materialize(nodes, "vertices")
    edges = materialize(edges, "edges")
    n, size = state.count(), edges.count()
    for _ in itertools.count() if max_iter is None else range(max_iter):
        wide = edges
        if "src_" in used:
            wide = wide.join(_state(state.select(F.col("node").alias("s"), *[F.col(a).alias(f"src_{a}") for a in attributes]), n), "s")
        if "dst_" in used:
            wide = wide.join(_state(state.select(F.col("node").alias("t"), *[F.col(a).alias(f"dst_{a}") for a in attributes]), n), "t")
        wide = wide.where(where) if where is not None else wide
        sent = wide.select(F.col("t").alias("__to"), *[c.alias(f"msg_{k}") for k, c in message.items()])
        if reverse is not None:
            sent = sent.union(wide.select(F.col("s").alias("__to"), *[reverse[k].alias(f"msg_{k}") for k in message]))
        got = sent.groupBy("__to").agg(*[f(F.col(f"msg_{k}")).alias(f"msg_{k}") for k, f in merge.items()])
        joined = state.join(got, state["node"] == got["__to"], "left")
        changed = F.lit(False)
        for k, c in combine.items():
            changed |= ~c.eqNullSafe(F.col(k))
        new = joined.select("node", *[(combine[a] if a in combine else F.col(a)).alias(a) for a in attributes], changed.alias("__changed"))
        old, whole = state, materialize(new, "vertices", max(n, size))
        forget(old)
        state = whole.drop("__changed")
        state._statflow_path = whole._statflow_path
        if not whole.where("__changed").limit(1).count():
            return state
    raise RuntimeError(f"no fix-point after {max_iter} passes")
