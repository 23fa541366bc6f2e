"""Bounded walks over call edges: callers, impact, reachability.

Edges go from a file to a name; a hop leads from a call edge to the symbol that its file defines (the base name). A
target answers to several symbols (its suffixes), so calls are exploded once into (symbol, edge) and each hop is an
equi-join with the distinct symbols of the frontier. Ranks are arrays of `ord` from the first hop on: their order is
that of a breadth-first queue, without a global row number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.names import caller_symbol, matches_alias, short_of, symbol_keys, targets_symbol
from ..model import DEPTH_CAP, DEQUEUE_GUARD, EDGE_COLUMNS
from ..plans.settle import settled


def clamp_depth(requested: int) -> int:
    return min(max(1, requested), DEPTH_CAP)


def _calls(edges: DataFrame) -> DataFrame:
    calls = edges.where("kind = 'call'").select(*EDGE_COLUMNS)
    return calls.withColumn("caller", caller_symbol(F.col("source"))).withColumn("edge_key", F.concat_ws("|", "source", "target", "line"))


def _by_symbol(calls: DataFrame, dots: bool) -> DataFrame:
    return calls.select("*", F.explode(symbol_keys(F.col("target"), dots)).alias("symbol"))


#: Symbols of a frontier that are broadcast at most; a larger one meets the calls in a shuffle.
FRONTIER = 100_000


def _callers(level: DataFrame) -> int:
    """How many symbols call, up to one more than FRONTIER."""
    return level.select("caller").distinct().limit(FRONTIER + 1).count()


def _hop(by_symbol: DataFrame, level: DataFrame, symbols: int, seen: DataFrame | None) -> DataFrame:
    """The call edges that call a caller of `level`, each after its first one in rank order; edges with a seen key are out."""
    frontier = level.groupBy(F.col("caller").alias("symbol")).agg(F.min("rank").alias("before"))
    frontier = F.broadcast(frontier) if symbols <= FRONTIER else frontier
    met = by_symbol.join(frontier, "symbol").groupBy("ord").agg(F.min("before").alias("before"), *(F.first(c).alias(c) for c in [*EDGE_COLUMNS[:-1], "caller", "edge_key"]))
    if seen is not None:
        met = met.join(seen, "edge_key", "left_anti")
    return met.withColumn("rank", F.concat("before", F.array("ord"))).drop("before")


def upstream(edges: DataFrame, symbol: str, depth: int) -> DataFrame:
    """The call edges that reach `symbol` within `depth` hops, with `hop` (the fewest) and `rank` (order within it).

    Rows that share (source, target, line) all appear, at the same hop; an edge appears once.
    """
    calls, by_symbol = _calls(edges), None
    level = settled(calls.where(targets_symbol(F.col("target"), symbol)).withColumn("rank", F.array("ord")))
    levels = [level.withColumn("hop", F.lit(1))]
    seen = level.select("edge_key").distinct()
    for hop in range(2, clamp_depth(depth) + 1):
        symbols = _callers(level)
        if not symbols:
            break
        by_symbol = by_symbol or settled(_by_symbol(calls, True))
        level = settled(_hop(by_symbol, level, symbols, seen))
        levels.append(level.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(level.select("edge_key").distinct())
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select(*EDGE_COLUMNS, "caller", "hop", "rank")


def impact_layers(walked: DataFrame) -> tuple[list[str], list[str]]:
    """Names that call the target directly and those that do so through others, in the order of the walk. A second
    extension of a file's name is cut off as well."""
    name = F.regexp_replace("caller", r"\.[^.]+$", "")
    first = walked.withColumn("name", name).groupBy("name").agg(F.min(F.struct("hop", "rank")).alias("at"))
    rows = first.orderBy("at").select("name", F.col("at.hop").alias("hop")).collect()
    return [r.name for r in rows if r.hop == 1], [r.name for r in rows if r.hop > 1]


def reach(edges: DataFrame, start: str, goal: str, depth: int) -> DataFrame | None:
    """The edges of the shortest call path from `start` to `goal` (first in the order of the walk), with `step` from 1 at
    the start's side; None without one."""
    calls, by_symbol = _calls(edges), None
    level = settled(calls.where(targets_symbol(F.col("target"), short_of(goal.lower()))).withColumn("rank", F.array("ord")))
    seen, wanted = None, short_of(start.lower())
    for _ in range(clamp_depth(depth)):
        found = level.where(F.col("caller") == wanted).agg(F.min("rank")).first()[0]
        if found:
            chain = {o: len(found) - i for i, o in enumerate(found)}
            steps = F.create_map(*(F.lit(x) for pair in chain.items() for x in pair))
            return calls.where(F.col("ord").isin(list(chain))).select(*EDGE_COLUMNS, F.try_element_at(steps, F.col("ord")).alias("step"))
        symbols = _callers(level)
        if not symbols:
            return None
        by_symbol = by_symbol or settled(_by_symbol(calls, False))
        level = settled(_hop(by_symbol, level, symbols, seen))
        keys = level.select("edge_key").distinct()
        seen = keys if seen is None else seen.unionByName(keys)
    return None


@dataclass
class Selection:
    """The first rows of a result and the count of all."""

    rows: list[Row]
    total: int


def select(edges: DataFrame, limit: int) -> Selection:
    """The first `limit` edges in order, and how many there are."""
    return Selection(edges.select(*EDGE_COLUMNS).orderBy("ord").limit(limit).collect(), edges.count())


def callers(edges: DataFrame, matching: DataFrame, limit: int) -> Selection:
    """Definitions of the target, calls of it, and then, call by call in queue order, the calls of each caller, until
    `limit` edges are gathered or DEQUEUE_GUARD calls are expanded; the total counts what was gathered.

    matching: the edges that match the target, filters applied; later hops see all call edges. While the walk goes on it
    has gathered fewer than `limit` edges, so the queue and the keys that are seen are small; only the last level can be
    large, and of it the first rows and a count are taken.
    """
    anchors = select(matching.where("kind = 'definition'"), limit)
    first = select(matching.where("kind = 'call'"), limit)
    rows, total = [*anchors.rows, *first.rows], anchors.total + first.total
    if total >= limit or not first.rows:
        return Selection(rows[:limit], total)
    spark = edges.sparkSession
    by_symbol = settled(_by_symbol(_calls(edges), False))
    seen = {f"{r.source}|{r.target}|{r.line}" for r in first.rows}
    queue, expanded, guard = first.rows, set(), DEQUEUE_GUARD
    while queue and total < limit and guard > 0:
        from ..functions.names import caller_of

        turns = []  # (place in the queue, symbol): a symbol that was expanded before gives nothing new
        for place, row in enumerate(queue[:guard]):
            symbol = caller_of(row.source)
            if symbol not in expanded:
                expanded.add(symbol)
                turns.append((place, symbol))
        guard -= len(queue)
        if not turns:
            break
        table = spark.createDataFrame(turns, "place int, symbol string")
        known = spark.createDataFrame([(k,) for k in sorted(seen)] or [("",)], "edge_key string")
        met = by_symbol.join(F.broadcast(table), "symbol").join(F.broadcast(known), "edge_key", "left_anti")
        met = met.groupBy("edge_key").agg(F.min(F.struct("place", "ord", *EDGE_COLUMNS[:-1])).alias("row")).select("edge_key", "row.*")
        met = settled(met)
        counts = dict(met.groupBy("place").count().collect())
        last, gathered = -1, total
        for place, _ in turns:
            if gathered >= limit:
                break
            last, gathered = place, gathered + counts.get(place, 0)
        taken = met.where(F.col("place") <= last)
        queue = taken.orderBy("place", "ord").limit(limit).collect()
        rows += queue
        total = gathered
        seen |= {r.edge_key for r in queue}
    return Selection([Row(**{c: r[c] for c in EDGE_COLUMNS}) for r in rows[:limit]], total)


def direct(edges: DataFrame, aliases: list[str], limit: int) -> Selection:
    """Edges whose target matches, without a walk."""
    return select(edges.where(matches_alias(F.col("target"), aliases)), limit)
