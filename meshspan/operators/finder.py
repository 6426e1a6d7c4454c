"""Relay chains along a route.

For each stretch between waypoints a depth-first search with backtracking walks
candidate relays that hear each other until one covers the next waypoint.  The
candidates of a stretch and their links are found by joins beforehand; a task
gets one route's small graph.  Routes of a small extent go by tile instead: a task
gets the routes that start in a tile and the sites around it, and looks at links
only where a search stands.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import R_RADIO

MAX_DEPTH = 32


def chain(start: str, goals: set[str], hears: dict[str, list[tuple[float, str]]], depth: int = MAX_DEPTH) -> list[str] | None:
    """Relays from ``start`` to the first that covers the goal, at most ``depth`` links away; nearest-to-goal first.

    A site on the way is not met twice.  A link that led nowhere is not tried
    again, from whichever side its site is reached later; the site itself may be.
    """
    path, on, failed = [start], {start}, set()

    def go() -> bool:
        here = path[-1]
        if here in goals:
            return True
        if len(path) > depth:
            return False
        for _, nxt in hears.get(here, ()):
            if nxt in on or (here, nxt) in failed:
                continue
            on.add(nxt)
            path.append(nxt)
            if go():
                return True
            failed.add((here, nxt))
            path.pop()
            on.remove(nxt)
        return False

    return path if go() else None


def _route(pdf: pd.DataFrame) -> pd.DataFrame:
    route = pdf["route"].iloc[0]
    covers: dict[int, list[str]] = {}
    hears: dict[str, list[tuple[float, str]]] = {}
    for kind, ord_, a, b, score in zip(pdf["kind"], pdf["ord"], pdf["a"], pdf["b"], pdf["score"]):
        if kind == "covers":
            covers.setdefault(int(ord_), []).append(a)
        elif kind == "hears":
            hears.setdefault(a, []).append((score, b))
    for v in hears.values():
        v.sort()
    ords, out, here = sorted({int(o) for o in pdf["ord"] if o >= 0}), [], None
    for o in ords:
        near = sorted(covers.get(o, []))
        if here is None:
            if not near:
                break
            here = near[0]
            out.append((route, o, 0, here, True))
            continue
        path = chain(here, set(near), hears)
        if path is None:
            out.append((route, o, 0, None, False))
            break  # the prefix is what is solved
        out += [(route, o, i, s, True) for i, s in enumerate(path) if i or s != here] or [(route, o, 0, here, True)]
        here = path[-1]
    return pd.DataFrame(out, columns=["route", "ord", "hop", "site", "solved"])


def find_chains(facts: DataFrame) -> DataFrame:
    """Chains from facts (route, kind, ord, a, b, score).

    ``covers``: site a hears waypoint ord.  ``hears``: sites a and b hear each
    other, ord is -1, score orders what is tried first.  ``waypoint``: waypoint
    ord exists.  A route ends with its first stretch that no chain bridges.
    """
    return facts.groupBy("route").applyInPandas(_route, "route long, ord long, hop long, site string, solved boolean")


TILE_DEG = 0.25  # of a tile, and the most that a route by tile extends


def _metres(la, lo, lat: float, lon: float):
    dp, dl = np.radians(lat - la) / 2, np.radians(lon - lo) / 2
    a = np.sin(dp) * np.sin(dp) + np.cos(np.radians(la)) * math.cos(math.radians(lat)) * np.sin(dl) * np.sin(dl)
    return 2 * R_RADIO * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


class _Net:
    """Sites of a tile, numbered in order of their slugs, by place; places in order of latitude."""

    def __init__(self, sites: pd.DataFrame, cover_m: float):
        sites = sites.sort_values("slug", ignore_index=True)
        self.slug, self.cover_m = sites["slug"].tolist(), cover_m
        rows = sites.groupby(["lat", "lon"], sort=True).indices
        self.sites = [sorted(x.tolist()) for x in rows.values()]
        self.la, self.lo = (np.array([k[i] for k in rows], float) for i in (0, 1))
        self.place = np.zeros(len(sites), int)
        for i, x in enumerate(self.sites):
            self.place[x] = i
        self.first = np.array([x[0] for x in self.sites], int)
        self.deg = cover_m / R_RADIO * 180 / math.pi * 1.01
        self.known: dict[tuple[float, float], np.ndarray] = {}

    def covering(self, at: tuple[float, float]) -> np.ndarray:
        if at not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            lo, hi = np.searchsorted(self.la, (at[0] - self.deg, at[0] + self.deg))
            d = _metres(self.la[lo:hi], self.lo[lo:hi], *at)
            self.known[at] = lo + np.flatnonzero(np.floor(d * 100 + 0.5) / 100 <= self.cover_m)
        return self.known[at]

    def covers(self, site: int, at: tuple[float, float]) -> bool:
        i = self.place[site]
        return bool(np.floor(_metres(self.la[i : i + 1], self.lo[i : i + 1], *at)[0] * 100 + 0.5) / 100 <= self.cover_m)


class _Links:
    """Sites that a site hears, those nearest to the route's end first; worked out a place at a time, when a search gets there."""

    def __init__(self, net: _Net, places: np.ndarray, end: tuple[float, float], hop_m: float):
        self.net, self.places, self.hop_m, self.seen = net, places, hop_m, {}
        self.score = _metres(net.la[places], net.lo[places], *end)

    def get(self, site: int, _=()):
        at = self.net.place[site]
        if at not in self.seen:
            near = np.flatnonzero(_metres(self.net.la[self.places], self.net.lo[self.places], self.net.la[at], self.net.lo[at]) <= self.hop_m)
            self.seen[at] = sorted((self.score[i], s) for i in near for s in self.net.sites[self.places[i]])
        return self.seen[at]


def _walk(net: _Net, route: int, ords: list[int], at: list[tuple[float, float]], hop_m: float) -> list[tuple]:
    out, here, links = [], None, None
    for o, p in zip(ords, at):
        if here is None:
            near = net.covering(p)
            if not len(near):
                break
            here = int(net.first[near].min())
            out.append((route, o, 0, net.slug[here], True))
            continue
        if net.covers(here, p):
            out.append((route, o, 0, net.slug[here], True))
            continue
        path, near = None, net.covering(p)
        if len(near):
            if links is None:
                links = _Links(net, np.unique(np.concatenate([net.covering(x) for x in at])), at[-1], hop_m)
            path = chain(here, {s for i in near for s in net.sites[i]}, links)
        if path is None:
            out.append((route, o, 0, None, False))
            break  # the prefix is what is solved
        out += [(route, o, i, net.slug[s], True) for i, s in enumerate(path) if i]
        here = path[-1]
    return out


def chains_by_tile(way: DataFrame, sites: DataFrame, cover_m: float, hop_m: float, tile_deg: float = TILE_DEG) -> tuple[DataFrame, DataFrame]:
    """Chains as of ``find_chains`` for the routes of ``way`` (route, ord, lat, lon) that extend ``tile_deg`` at most, and the waypoints of the others.

    ``sites`` have slug, lat, lon; a site covers waypoints within ``cover_m`` (to the
    centimetre) and hears others of its route's sites within ``hop_m``.
    """
    w = Window.partitionBy("route")
    south, north, west, east = F.min("lat").over(w), F.max("lat").over(w), F.min("lon").over(w), F.max("lon").over(w)
    way = way.select("route", "ord", "lat", "lon", south.alias("south"), west.alias("west"), ((north - south <= tile_deg) & (east - west <= tile_deg)).alias("small"))
    tile = lambda c: F.floor(c / tile_deg)
    small = way.filter("small").select("route", "ord", "lat", "lon", tile(F.col("south")).alias("ty"), tile(F.col("west")).alias("tx"))
    deg = cover_m / R_RADIO * 180 / math.pi * 1.02
    wide = F.lit(deg) / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + tile_deg + deg)))
    span = lambda c, m: F.explode(F.sequence(tile(F.col(c) - tile_deg - m), tile(F.col(c) + m)))
    around = sites.select("slug", "lat", "lon").withColumn("ty", span("lat", F.lit(deg))).withColumn("tx", span("lon", wide))

    def run(routes: pd.DataFrame, sites: pd.DataFrame) -> pd.DataFrame:
        net, out = _Net(sites, cover_m), []
        routes = routes.sort_values(["route", "ord"], kind="stable")
        key, ords, at = routes["route"].to_numpy(), routes["ord"].tolist(), list(zip(routes["lat"].tolist(), routes["lon"].tolist()))
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(edges, edges[1:]):
            if i < j and len(net.slug):
                out += _walk(net, int(key[i]), ords[i:j], at[i:j], hop_m)
        return pd.DataFrame(out, columns=["route", "ord", "hop", "site", "solved"])

    found = small.groupBy("ty", "tx").cogroup(around.groupBy("ty", "tx")).applyInPandas(run, "route long, ord long, hop long, site string, solved boolean")
    return found, way.filter("not small").select("route", "ord", "lat", "lon")
