"""Edges taken out of the identity graph so that clusters stay plausible."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.functions.names import given
from linkwright.operators.graph import bridges_and_cuts, connected_components, edges_by_component

#: Rounds of taking an edge from an oversized cluster.
ROUNDS = 1000


def prune_light(edges: DataFrame, least: float = 0.4) -> DataFrame:
    """Edges of at least that weight; a missing weight is 0."""
    return edges.filter(F.coalesce("weight", F.lit(0.0)) >= least)


def _pieces(nodes: set[str], near: dict[str, dict[str, float]]) -> list[set[str]]:
    out, seen = [], set()
    for n in sorted(nodes):
        if n not in seen:
            piece, todo = {n}, [n]
            while todo:
                for m in near.get(todo.pop(), ()):
                    if m not in piece:
                        piece.add(m)
                        todo.append(m)
            seen |= piece
            out.append(piece)
    return out


def prune_component(edges: list[tuple[str, str, float]], npis: dict[str, str], conflicts: bool, most: int | None, bridges_below: float | None) -> set[tuple[str, str]]:
    """What is left of one component's edges after the asked-for prunings, in this order.

    conflicts: while a piece has several npis, its lightest edge that touches a
    node with an npi is taken out. most: in each of at most ROUNDS rounds the
    lightest edge of every larger piece is taken out. bridges_below: bridges
    lighter than that are taken out of pieces of more than two nodes. Of edges
    of one weight the smaller pair goes first.
    """
    near: dict[str, dict[str, float]] = {}
    for u, v, w in edges:
        near.setdefault(u, {})[v] = w
        near.setdefault(v, {})[u] = w

    def inside(piece: set[str]) -> list[tuple[float, str, str]]:
        return [(w, u, v) for u in piece for v, w in near[u].items() if u < v]

    def drop(u: str, v: str) -> None:
        del near[u][v], near[v][u]

    if conflicts:
        todo = _pieces(set(near), near)
        while todo:
            piece = todo.pop()
            while len({npis[n] for n in piece if n in npis}) > 1:
                touching = [e for e in inside(piece) if e[1] in npis or e[2] in npis]
                if not touching:
                    break
                _, u, v = min(touching)
                drop(u, v)
                parts = _pieces(piece, near)
                if len(parts) > 1:
                    todo += parts
                    break
    if most is not None:
        todo = [(p, 0) for p in _pieces(set(near), near)]
        while todo:
            piece, spent = todo.pop()
            while len(piece) > most and spent < ROUNDS:
                own = inside(piece)
                if not own:
                    break
                _, u, v = min(own)
                drop(u, v)
                spent += 1
                parts = _pieces(piece, near)
                if len(parts) > 1:
                    todo += [(p, spent) for p in parts]
                    break
    if bridges_below is not None:
        for piece in _pieces(set(near), near):
            if len(piece) > 2:
                own = inside(piece)
                found, _ = bridges_and_cuts((u, v) for _, u, v in own)
                for w, u, v in own:
                    if (u, v) in found and w < bridges_below:
                        drop(u, v)
    return {(u, v) for u in near for v in near[u] if u < v}


def prune(vertices: DataFrame, edges: DataFrame, conflicts: bool = True, most: int | None = 100, bridges_below: float | None = 0.5) -> DataFrame:
    """Edges left after the prunings of prune_component, made in each component by itself.

    Taking edges out never joins components, so each can be treated alone. Only
    components in need of it (several npis, too many nodes, a light edge) leave
    the JVM; the others pass as they are. A component that does is held by one
    task: its edges and npis.
    """
    components = connected_components(vertices, edges)
    placed = edges_by_component(edges, components)
    v = vertices.join(components, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(given(F.col("npi"))).alias("npis"))
    light = placed.groupBy("component").agg(F.min("weight").alias("lightest"))
    need = F.lit(False)
    if conflicts:
        need = need | (F.col("npis") > 1)
    if most is not None:
        need = need | (F.col("n") > most)
    if bridges_below is not None:
        need = need | ((F.col("n") > 2) & (F.col("lightest") < bridges_below))
    sick = v.join(light, "component").filter(need).select("component")
    npi = vertices.select("id", given(F.col("npi")).alias("npi"))
    ends = placed.join(sick, "component", "left_semi").join(npi.select(F.col("id").alias("src"), F.col("npi").alias("npi_src")), "src", "left").join(npi.select(F.col("id").alias("dst"), F.col("npi").alias("npi_dst")), "dst", "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        npis = {n: x for a, b in (("src", "npi_src"), ("dst", "npi_dst")) for n, x in zip(part[a], part[b]) if x}
        left = prune_component(list(zip(part["src"], part["dst"], part["weight"])), npis, conflicts, most, bridges_below)
        return part[[e in left for e in zip(part["src"], part["dst"])]][["src", "dst"]]

    left = ends.select("component", "src", "dst", "weight", "npi_src", "npi_dst").groupBy("component").applyInPandas(run, "src string, dst string")
    return placed.join(sick, "component", "left_anti").drop("component").select(*edges.columns).unionByName(edges.join(left, ["src", "dst"], "left_semi").select(*edges.columns))


def prune_npi_conflicts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return prune(vertices, edges, True, None, None)


def prune_oversized(vertices: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    return prune(vertices, edges, False, most, None)


def prune_weak_bridges(vertices: DataFrame, edges: DataFrame, below: float = 0.5) -> DataFrame:
    return prune(vertices, edges, False, None, below)


def prune_all(vertices: DataFrame, edges: DataFrame, min_weight: float = 0.4, most: int = 100, conflicts: bool = True) -> DataFrame:
    """Light edges (below three quarters of min_weight), npi conflicts, oversized clusters, weak bridges (below min_weight)."""
    return prune(vertices, prune_light(edges, min_weight * 0.75), conflicts, most, min_weight)
