"""Shortest paths on a road graph, for distinct origin-destination pairs only.

Pairs are grouped by origin: one run of Dijkstra's algorithm serves all destinations of it.
The graph of a city (a few hundred thousand edges) is a broadcast value whose size is checked.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAPH_EDGES = 20_000_000  # documented bound of a graph that is held by every worker
SAME_NODE_S = 60.0


def _graph(edges: DataFrame, weight: str):
    """Compressed rows: for each node the ends and weights of its cheapest edges."""
    least = edges.groupBy("u", "v").agg(F.min(weight).cast("double").alias("w"))
    if least.count() > GRAPH_EDGES:
        raise ValueError("the graph exceeds the bound for broadcasting; route by region")
    rows = least.orderBy("u", "v").toPandas()
    nodes = np.unique(np.concatenate([rows["u"], rows["v"]])) if len(rows) else np.zeros(0, np.int64)
    u, v = np.searchsorted(nodes, rows["u"]), np.searchsorted(nodes, rows["v"])
    return nodes, np.searchsorted(u, np.arange(len(nodes) + 1)), v, rows["w"].to_numpy()


def dijkstra(graph, origin: int, goals: set[int]) -> dict[int, tuple[float, list[int]]]:
    """Cost and node path from ``origin`` to each reachable goal."""
    nodes, rows, ends, weights = graph
    at = {int(n): i for i, n in enumerate(nodes)} if len(nodes) < 50_000 else None
    place = (lambda n: at.get(n, -1)) if at is not None else (lambda n: int(i) if (i := np.searchsorted(nodes, n)) < len(nodes) and nodes[i] == n else -1)
    start = place(origin)
    todo = {place(g) for g in goals} - {-1}
    if start < 0:
        return {}
    cost, before, done, heap = {start: 0.0}, {}, set(), [(0.0, start)]
    while heap and todo:
        c, i = heapq.heappop(heap)
        if i in done:
            continue
        done.add(i)
        todo.discard(i)
        for k in range(rows[i], rows[i + 1]):
            j, d = int(ends[k]), c + weights[k]
            if d < cost.get(j, np.inf):
                cost[j], before[j] = d, i
                heapq.heappush(heap, (d, j))
    out = {}
    for g in goals:
        j = place(g)
        if j in done:
            path = [j]
            while path[-1] != start:
                path.append(before[path[-1]])
            out[g] = (cost[j], [int(nodes[x]) for x in reversed(path)])
    return out


def shortest_paths(pairs: DataFrame, edges: DataFrame, weight: str = "travel_time") -> DataFrame:
    """(o, d, cost, nodes) for distinct (o, d); no path: no row.

    Origin and destination in one node: two points and a minute by travel time, 0 by length.
    """
    sc = edges.sparkSession.sparkContext
    graph = sc.broadcast(_graph(edges, weight))
    same_cost = SAME_NODE_S if weight == "travel_time" else 0.0

    def route(rows: pd.DataFrame) -> pd.DataFrame:
        o = int(rows["o"].iloc[0])
        goals = {int(d) for d in rows["d"]}
        found = dijkstra(graph.value, o, goals - {o})
        out = [(o, o, same_cost, [o, o])] if o in goals else []
        out += [(o, d, c, path) for d, (c, path) in sorted(found.items())]
        return pd.DataFrame(out, columns=["o", "d", "cost", "nodes"])

    distinct = pairs.select("o", "d").where("o is not null and d is not null").distinct()
    return distinct.groupBy("o").applyInPandas(route, "o long, d long, cost double, nodes array<long>")


def timed_points(paths: DataFrame, nodes: DataFrame, edges: DataFrame, slow: float = 1.0) -> DataFrame:
    """(o, d, i, node_id, lon, lat, offset): path points and the running travel time before each."""
    times = edges.groupBy("u", "v").agg((F.min("travel_time") * slow).alias("tt"))
    steps = paths.select("o", "d", F.posexplode("nodes").alias("i", "node_id"), F.col("nodes").alias("p"))
    steps = steps.withColumn("prev", F.when(F.col("i") > 0, F.element_at("p", F.col("i").cast("int")))).drop("p")
    j = steps.join(times, (F.col("prev") == F.col("u")) & (F.col("node_id") == F.col("v")), "left")
    own = F.when(F.col("i") == 0, 0.0).when(F.col("prev") == F.col("node_id"), SAME_NODE_S).otherwise(F.col("tt"))
    from pyspark.sql import Window

    offset = F.sum(own).over(Window.partitionBy("o", "d").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    xy = nodes.select("node_id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return j.withColumn("offset", offset).join(xy, "node_id").select("o", "d", "i", "node_id", "lon", "lat", "offset")


def edge_usage(paths: DataFrame) -> DataFrame:
    """(u, v, n): how often each edge is used; a stay in one node uses none."""
    hops = paths.select(F.explode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("u"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("v"))).alias("e"))
    return hops.select("e.u", "e.v").where("u <> v").groupBy("u", "v").agg(F.count("*").alias("n"))
