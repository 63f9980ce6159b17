"""Cheapest maximum matchings of two kinds of rows, component by component.

Edges join a left row to a right one at a cost. Rows that no chain of edges joins never compete, so each connected
component is matched alone: first as many pairs as possible, of these matchings the one of least total cost. A left
row is certain if every such matching has a pair for it; which of several equal matchings is given depends on the
names of the rows alone.

Defined results: of several edges of one pair the cheapest counts; edges with a null end or cost are left out. Costs
are whole numbers of 0 or more. A component is held by one task; one of more than `most` edges is not matched and
comes out with solved false, for the caller to decide, as do all its left rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.graph import components
from tidemark.session import share_package

#: Edges of a component, which one task holds.
MOST_EDGES = 1_000_000


def cheapest(edges: list[list[tuple[int, int]]], rights: int) -> tuple[list[int | None], list[bool]]:
    """For each left row its right row or None, and whether it is certain; edges has (right, cost) pairs by left row.

    Pairs are added along cheapest augmenting paths. Prices of the rows keep all remaining costs at 0 or more, so
    each path is found from the nearest rows outwards; prices are also what tells certain rows in the end.
    """
    lefts = len(edges)
    partner: list[int | None] = [None] * lefts
    owner: list[int | None] = [None] * rights
    price = [0] * (lefts + rights)
    paid = [dict(e) for e in edges]
    while True:
        # what a walk costs by prices is its cost, plus the price where it begins, less that where it ends
        free = [k for k in range(lefts) if partner[k] is None]
        base = max((price[k] for k in free), default=0)
        reach = {k: base - price[k] for k in free}
        came: dict[int, int] = {}
        queue = [(d, k) for k, d in reach.items()]
        heapq.heapify(queue)
        best, last = None, None
        settled: set[int] = set()
        while queue:
            d, node = heapq.heappop(queue)
            if node in settled or best is not None and d >= best:
                continue
            settled.add(node)
            if node < lefts:
                for right, cost in edges[node]:
                    there, step = lefts + right, d + cost + price[node] - price[lefts + right]
                    if partner[node] != right and step < reach.get(there, step + 1):
                        reach[there], came[there] = step, node
                        heapq.heappush(queue, (step, there))
            elif owner[node - lefts] is None:
                total = d + price[node]
                if best is None or total < best:
                    best, last = total, node
            else:
                left = owner[node - lefts]
                step = d - paid[left][node - lefts] + price[node] - price[left]
                if step < reach.get(left, step + 1):
                    reach[left], came[left] = step, node
                    heapq.heappush(queue, (step, left))
        if last is None:
            return partner, _certain(edges, partner, owner)
        node = last
        while True:
            left = came[node]
            partner[left], owner[node - lefts] = node - lefts, left
            if left not in came:
                break
            node = came[left]
        price = _prices(lefts + rights, list(_steps(edges, partner)))


def _steps(edges: list[list[tuple[int, int]]], partner: list[int | None]) -> Iterator[tuple[int, int, int]]:
    """The steps that are left: to any right row but a left row's own, and back from that."""
    lefts = len(edges)
    for left, out in enumerate(edges):
        for right, cost in out:
            yield (lefts + right, left, -cost) if partner[left] == right else (left, lefts + right, cost)


def _prices(rows: int, steps: list[tuple[int, int, int]]) -> list[int]:
    """Least costs of walks that end at each row: with them no step costs less than 0."""
    price = [0] * rows
    changed = True
    while changed:
        changed = False
        for a, b, cost in steps:
            if price[a] + cost < price[b]:
                price[b], changed = price[a] + cost, True
    return price


def _certain(edges: list[list[tuple[int, int]]], partner: list[int | None], owner: list[int | None]) -> list[bool]:
    """Whether each left row has a pair in every cheapest maximum matching.

    It can go without one only where a walk of no cost gives its place to a left row that has none, or takes the pair
    elsewhere: such walks use steps whose cost by prices is 0. Rows without a pair, on either side, have one price.
    """
    lefts = len(edges)
    source, sink = lefts + len(owner), lefts + len(owner) + 1
    steps = list(_steps(edges, partner))
    steps += [(source, k, 0) if p is None else (k, source, 0) for k, p in enumerate(partner)]
    steps += [(lefts + k, sink, 0) if o is None else (sink, lefts + k, 0) for k, o in enumerate(owner)]
    price = _prices(sink + 1, steps)
    free: dict[int, list[int]] = {}
    for a, b, cost in steps:
        if cost + price[a] - price[b] == 0:
            free.setdefault(a, []).append(b)
    seen, queue = {source}, [source]
    while queue:
        for b in free.get(queue.pop(), []):
            if b not in seen:
                seen.add(b)
                queue.append(b)
    return [p is not None and not (k in seen and source in free.get(k, [])) for k, p in enumerate(partner)]


def matched(edges: DataFrame, left: str = "left", right: str = "right", cost: str = "cost", most: int = MOST_EDGES) -> DataFrame:
    """left, right (null where it has none), cost, certain and solved: one row for each left row that has an edge."""
    share_package(edges.sparkSession)
    known = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).agg(F.min(F.col(cost).cast("long")).alias("cost")).where("cost is not null")
    # the two kinds of rows may have equal names
    linked = known.select(F.concat(F.lit("l"), "a").alias("a"), F.concat(F.lit("r"), "b").alias("b"))
    roots = components(linked).where("node like 'l%'").select(F.expr("substring(node, 2)").alias("a"), "root")
    placed = known.join(roots, "a")
    sizes = placed.groupBy("root").agg(F.count("*").alias("edges"))
    sized = placed.join(sizes, "root")
    small = sized.where(F.col("edges") <= most).select("root", "a", "b", "cost")

    def solve(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        lefts = {a: k for k, a in enumerate(sorted({a for a, _, _ in rows}))}
        names = sorted({b for _, b, _ in rows})
        rights = {b: k for k, b in enumerate(names)}
        out: list[list[tuple[int, int]]] = [[] for _ in lefts]
        for a, b, c in sorted(rows):
            out[lefts[a]].append((rights[b], c))
        partner, certain = cheapest(out, len(rights))
        costs = [None if p is None else dict(out[k])[p] for k, p in enumerate(partner)]
        columns = [pa.array(list(lefts), pa.string()), pa.array([None if p is None else names[p] for p in partner], pa.string()), pa.array(costs, pa.int64()), pa.array(certain, pa.bool_()), pa.array([True] * len(lefts), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["left", "right", "cost", "certain", "solved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, rows = None, []
        for batch in batches:
            for r, a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if r != root and rows:
                    yield solve(rows)
                    rows = []
                root = r
                rows.append((a, b, c))
        if rows:
            yield solve(rows)

    pairs = small.repartition("root").sortWithinPartitions("root").mapInArrow(run, "left string, right string, cost bigint, certain boolean, solved boolean")
    large = sized.where(F.col("edges") > most).select(F.col("a").alias("left"), F.lit(None).cast("string").alias("right"), F.lit(None).cast("long").alias("cost"), F.lit(False).alias("certain"), F.lit(False).alias("solved")).distinct()
    return pairs.unionByName(large)
