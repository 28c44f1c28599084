"""Bags of rows compared up to a tolerance: a perfect matching, found piece by piece.

Two rows may stand for each other if their numbers differ by less than the
tolerance and their other values are equal. Whether all rows of two bags can be
paired is not decided by any greedy order, but by augmenting paths over the pairs
that may stand for each other. A bag of up to ``SMALL`` distinct rows, of which
there may be very many, is decided where it stands. In a larger one the pairs
form a graph, found by a grid of values; its connected components are
independent, and each is decided by itself.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import materialise


#: Distinct rows of both sides of a bag that is decided where it stands, and how many such bags at once.
SMALL, AT_ONCE = 32, 4096


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` links of whole numbers -> ``node, root``: the least node that each reaches.

    Each round takes the least label among neighbours, then follows labels of
    labels, so that the rounds grow with the logarithm of the longest path.
    """
    both = materialise(edges.select("u", "v").union(edges.select("v", "u")).distinct().toDF("u", "v"), "match-links")
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).select(F.col("u").alias("node"), F.col("l").alias("root"))
    labels = materialise(labels, "match-roots")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", "root", F.least("root", "least").alias("to"))
        lower = materialise(lower, "match-lower")
        jump = lower.select(F.col("node").alias("j"), F.col("to").alias("j_to"))
        done = lower.join(jump, F.col("to") == F.col("j")).select("node", F.col("j_to").alias("root"), (F.col("j_to") != F.col("root")).alias("moved"))
        done = materialise(done, "match-roots")
        labels = done.select("node", "root")
        if done.where("moved").isEmpty():
            return labels


def saturated(supply: dict[int, int], demand: dict[int, int], links: dict[int, list[int]]) -> bool:
    """Whether all supply can be dealt to all demand along the links: augmenting paths, shortest first, each as wide as it can be."""
    if sum(supply.values()) != sum(demand.values()):
        return False
    left, room = dict(supply), dict(demand)
    dealt: dict[int, dict[int, int]] = {r: {} for r in demand}  # result -> gold -> how many
    while any(left.values()):
        came: dict[tuple[str, int], tuple[str, int] | None] = {("g", g): None for g, n in left.items() if n}
        todo, end = deque(came), None
        while todo and end is None:
            side, x = todo.popleft()
            for y in links.get(x, ()) if side == "g" else [g for g, n in dealt[x].items() if n]:
                step = ("r" if side == "g" else "g", y)
                if step not in came:
                    came[step] = (side, x)
                    if side == "g" and room[y]:
                        end = step
                        break
                    todo.append(step)
        if end is None:
            return False
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()  # g r g r ... r
        width = min([left[path[0][1]], room[end[1]], *(dealt[path[i][1]][path[i + 1][1]] for i in range(1, len(path) - 1, 2))])
        for i in range(0, len(path), 2):
            g, r = path[i][1], path[i + 1][1]
            dealt[r][g] = dealt[r].get(g, 0) + width
            if i + 2 < len(path):
                dealt[r][path[i + 2][1]] -= width
        left[path[0][1]] -= width
        room[end[1]] -= width
    return True


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _classes(df: DataFrame, by: list[str], columns: list[str], numbers: list[str], side: int) -> DataFrame:
    """Distinct rows of each bag and how often they occur; ``id`` is even on one side and odd on the other."""
    value = lambda c: F.col(c).cast("double") + 0.0 if c in numbers else F.col(c)  # noqa: E731  minus zero is zero
    rows = df.select(*by, *[value(c).alias(c) for c in columns]).groupBy(*by, *columns).agg(F.count("*").alias("n"))
    return rows.withColumn("id", F.monotonically_increasing_id() * 2 + side)


def _cell(value: Column, tolerance: float) -> Column:
    """The number of the value's cell; numbers that have none (null, NaN, infinite, beyond longs) have cells of their own."""
    inside = F.abs(value / tolerance) < 4e18
    return F.when(value.isNull(), F.lit("null")).when(F.isnan(value), F.lit("nan")).when(inside, F.floor(value / tolerance).cast("string")).otherwise(value.cast("string"))


def _close(fields: list[pa.Array], numbers: list[bool], u: np.ndarray, v: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether rows u and v may stand for each other."""
    close = np.ones(len(u), bool)
    for f, number in zip(fields, numbers, strict=True):
        if number:
            null, x = f.is_null().to_numpy(zero_copy_only=False), f.fill_null(0.0).to_numpy(zero_copy_only=False)
            a, b = x[u], x[v]
            with np.errstate(invalid="ignore"):
                near = (a == b) | (np.isnan(a) & np.isnan(b)) | (np.abs(a - b) < tolerance)
            close &= np.where(null[u] | null[v], null[u] & null[v], near)
        else:
            code = f.dictionary_encode(null_encoding="encode").indices.to_numpy()
            close &= code[u] == code[v]
    return close


def _in_place(by: list[str], numbers: list[bool], tolerance: float):
    """Bags with their rows ``m`` (side, n, values) -> whether they pair up."""

    def decided(batch: pa.RecordBatch) -> np.ndarray:
        size = batch.column("m").value_lengths().to_numpy()
        bag, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        side, n, *fields = batch.column("m").flatten().flatten()
        side, n = side.to_numpy(), n.to_numpy()
        gold = np.flatnonzero(side == 0)
        times = size[bag[gold]]
        u = np.repeat(gold, times)
        v = np.arange(len(u)) - np.repeat(np.cumsum(times) - times, times) + start[bag[u]]
        u, v = u[side[v] == 1], v[side[v] == 1]
        met = _close(fields, numbers, u, v, tolerance)
        u, v = u[met], v[met]
        ok = batch.column("n_gold").to_numpy() == batch.column("n_result").to_numpy()
        ok[bag[np.bincount(np.append(u, v), minlength=len(bag)) == 0]] = False
        first, n, side, u_list, v_list = np.searchsorted(u, np.append(start, len(bag))).tolist(), n.tolist(), side.tolist(), u.tolist(), v.tolist()
        for i in np.flatnonzero(ok).tolist():
            links: dict[int, list[int]] = {}
            for e in range(first[i], first[i + 1]):
                links.setdefault(u_list[e], []).append(v_list[e])
            rows = range(int(start[i]), int(start[i] + size[i]))
            ok[i] = saturated({j: n[j] for j in rows if side[j] == 0}, {j: n[j] for j in rows if side[j] == 1}, links)
        return ok

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                columns = [batch.column(c) for c in [*by, "n_gold", "n_result"]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(decided(batch))], [*by, "n_gold", "n_result", "matches"])

    return run


def tolerant_rows(gold: DataFrame, result: DataFrame, by: list[str], columns: list[str], tolerance: float = 0.005, grid: int = 2) -> DataFrame:
    """Per bag (rows of equal ``by``) ``by, n_gold, n_result, matches``: whether its rows pair up one to one.

    Nulls stand for nulls and NaN for NaN; a bag that one side lacks does not
    match. Rows are compared as distinct ones with their numbers, so that a row
    repeated any number of times is one node. In bags of more than ``SMALL``
    distinct rows candidates are found by the first ``grid`` numeric columns;
    text columns and bags join by equality. The graph of distinct rows within the
    tolerance is dealt into its components, one task each.
    """
    numbers = [c for c in columns if _numeric(gold, c) and _numeric(result, c)]
    g, r = (materialise(_classes(d, by, columns, numbers, i), "match-rows") for i, d in enumerate((gold, result)))
    alike = lambda c: gold.schema[c].dataType == result.schema[c].dataType and isinstance(gold.schema[c].dataType, T.AtomicType)
    if not all(c in numbers or alike(c) for c in columns) or not all(gold.schema[c].dataType == result.schema[c].dataType for c in by):
        return _by_components(g, r, by, columns, numbers, tolerance, grid)
    both = g.withColumn("side", F.lit(0)).unionByName(r.withColumn("side", F.lit(1)))
    large = materialise(both.groupBy(*[F.col(c).alias(f"l_{c}") for c in by]).count().where(F.col("count") > SMALL), "match-large")
    in_large = F.lit(True)
    for c in by:
        in_large = in_large & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    some = not large.isEmpty()
    few = both.join(large, in_large, "left_anti") if some else both
    side = lambda i: F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0))
    row = F.struct("side", "n", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    bags = few.groupBy(*by).agg(side(0).alias("n_gold"), side(1).alias("n_result"), F.collect_list(row).alias("m"))
    schema = T.StructType([*[gold.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in ("n_gold", "n_result")], T.StructField("matches", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    out = bags.mapInArrow(_in_place(by, [c in numbers for c in columns], tolerance), schema)
    if not some:
        return out
    g, r = (d.join(large, in_large, "left_semi") for d in (g, r))
    return out.unionByName(_by_components(g, r, by, columns, numbers, tolerance, grid))


def _by_components(g: DataFrame, r: DataFrame, by: list[str], columns: list[str], numbers: list[str], tolerance: float, grid: int) -> DataFrame:
    """``tolerant_rows`` of bags of any size, given their distinct rows with ids."""
    gridded = numbers[:grid]
    left = g.select(*[F.col(c).alias(f"g_{c}") for c in [*by, *columns, "id"]], *[_cell(F.col(c), tolerance).alias(f"__a{i}") for i, c in enumerate(gridded)])
    right = r.select(*[F.col(c).alias(f"r_{c}") for c in [*by, *columns, "id"]])
    for i, c in enumerate(gridded):  # a row of the result is sought in its cell and the two beside it
        v = F.col(f"r_{c}")
        right = right.withColumn(f"__b{i}", F.explode(F.array_distinct(F.array(_cell(v, tolerance), _cell(v - tolerance, tolerance), _cell(v + tolerance, tolerance)))))
    on = F.lit(True)
    for c in [*by, *(c for c in columns if c not in numbers)]:
        on = on & F.col(f"g_{c}").eqNullSafe(F.col(f"r_{c}"))
    for i in range(len(gridded)):
        on = on & (F.col(f"__a{i}") == F.col(f"__b{i}"))
    close = F.lit(True)
    for c in numbers:
        x, y = F.col(f"g_{c}"), F.col(f"r_{c}")
        close = close & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) < tolerance, F.lit(False)))
    edges = materialise(left.join(right, on).where(close).select(F.col("g_id").alias("u"), F.col("r_id").alias("v")).distinct(), "match-edges")

    roots = components(edges)
    counted = roots.join(g.select("id", "n").union(r.select("id", "n")), F.col("node") == F.col("id")).select("root", "node", "n")
    each = edges.join(roots, F.col("u") == F.col("node")).select("root", "u", F.col("v").alias("v"), F.lit(None).cast("long").alias("n"))
    parts = each.unionByName(counted.select("root", F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), "n"))

    def decide(key, table):
        supply, demand, links = {}, {}, {}
        for u, v, n in zip(*(table[c].to_pylist() for c in ("u", "v", "n")), strict=True):
            if n is None:
                links.setdefault(u, []).append(v)
            else:
                (demand if u % 2 else supply)[u] = n
        return pa.table({"root": pa.array([key[0].as_py()], pa.int64()), "paired": pa.array([saturated(supply, demand, {k: sorted(x) for k, x in links.items()})])})

    paired = parts.groupBy("root").applyInArrow(decide, "root long, paired boolean").withColumnRenamed("root", "p_root")
    node = roots.join(paired, F.col("root") == F.col("p_root")).select("node", "paired")
    sides = [d.select(*by, "id", F.when(F.lit(i == 0), F.col("n")).otherwise(0).alias("n_gold"), F.when(F.lit(i == 1), F.col("n")).otherwise(0).alias("n_result")) for i, d in enumerate((g, r))]
    rows = sides[0].unionByName(sides[1]).join(node, F.col("id") == F.col("node"), "left")
    return rows.groupBy(*by).agg(F.sum("n_gold").alias("n_gold"), F.sum("n_result").alias("n_result"), F.bool_and(F.coalesce("paired", F.lit(False))).alias("matches"))
