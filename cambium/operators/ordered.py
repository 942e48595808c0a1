"""As-of lookups, innermost intervals, nearest scopes, event logs, running decodes, first and last occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.operators.scratch import cut, free


def asof_position(queries: DataFrame, positions: DataFrame, keys: list[str], at: str, spread: bool = False) -> DataFrame:
    """queries (keys, at, query columns) with found: the greatest position (keys, at) that is not after at; null if none.

    One sort of the union, no range join. A position equal to the query's counts. With spread, a key's rows are dealt to
    many tasks by range and the last position of each task is carried to the next: for keys with more rows than one task
    should sort.
    """
    points = positions.select(*keys, at).distinct()
    extra = [c for c in queries.columns if c not in (*keys, at)]
    q = queries.select(*keys, at, F.lit(1).alias("_query"), F.struct(*extra).alias("_row") if extra else F.lit(0).alias("_row"))
    p = points.select(*keys, at, F.lit(0).alias("_query"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"))
    both = p.unionByName(q)
    group = list(keys)
    known = F.when(F.col("_query") == 0, F.col(at))
    if spread:
        both = cut(both.repartitionByRange(*keys, at, "_query").withColumn("_part", F.spark_partition_id()), "spread")
        group.append("_part")
    w = Window.partitionBy(*group).orderBy(at, "_query").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(known, ignorenulls=True).over(w)
    if spread:
        last = both.groupBy(*group).agg(F.max(known).alias("_last"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        both = both.join(last.withColumn("_carried", F.max("_last").over(before)).drop("_last"), group)
        found = F.coalesce(found, F.col("_carried"))
    both = both.withColumn("found", found).where("_query = 1")
    return both.select(*keys, at, *[F.col("_row")[c].alias(c) for c in extra], "found")


def asof_rows(queries: DataFrame, rows: DataFrame, keys: list[str], at: str, spread: bool = False) -> DataFrame:
    """As asof_position, joined with every row at the found position: ties all count, queries without any stay once."""
    found = asof_position(queries, rows, keys, at, spread)
    return found.join(rows.withColumnRenamed(at, "found"), [*keys, "found"], "left")


def innermost(points: DataFrame, intervals: DataFrame, at: str = "at") -> DataFrame:
    """points with the deepest of the intervals (interval, lo, hi, depth) that hold them (lo <= at < hi).

    An interval stands in the one or two cells of the least power of two that is as wide as it is, so that the range test
    becomes an equi-join: a point asks in one cell of each width that occurs (64 at most). Ties take the lowest name.
    """
    level = F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double"))).cast("int")
    held = intervals.where("lo < hi").withColumn("level", level)
    cell = lambda x: F.expr(f"shiftright(cast({x} AS bigint), level)")
    held = held.withColumn("cell", F.explode(F.array_distinct(F.array(cell("lo"), cell("hi - 1")))))
    levels = sorted(r.level for r in held.select("level").distinct().collect())  # 64 rows at most
    asked = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("cell", cell(at))
    met = asked.join(held, ["level", "cell"]).where((F.col("lo") <= F.col(at)) & (F.col(at) < F.col("hi")))
    best = met.groupBy(*points.columns).agg(F.max(F.struct("depth", (-F.col("interval")).alias("name"))).alias("best"))
    return points.join(best, points.columns, "left").select(*points.columns, (-F.col("best.name")).alias("interval"))


#: Kinds of leaves that can bind a name.
BINDING_LEAVES = ["identifier", "shorthand_property_identifier_pattern", "shorthand_property_identifier"]


def smallest_starting_at(points: DataFrame, nodes: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """points (keys, at) with node_ix: of the named nodes that start at that byte the shortest, of equals one that can bind
    a name, then the first; null if none starts there."""
    rank = F.struct((F.col("end_byte") - F.col("start_byte")).alias("size"), (~F.col("kind").isin(BINDING_LEAVES)).alias("other"), "node_ix")
    best = nodes.where("named").groupBy(*keys, F.col("start_byte").alias(at)).agg(F.min(rank)["node_ix"].alias("node_ix"))
    return points.join(best, [*keys, at], "left")


def scope_closure(scopes: DataFrame) -> DataFrame:
    """(scope, ancestor, distance) for scopes (scope, parent), each its own ancestor at 0, up to the outermost.

    Distances double from round to round: as many rounds as the depth has binary digits.
    """
    out = cut(scopes.select("scope", F.col("scope").alias("ancestor"), F.lit(0).alias("distance")), "closure")
    jump = cut(scopes.where("parent IS NOT NULL AND parent != scope").select("scope", F.col("parent").alias("up")), "jump")
    step, most = 1, scopes.count()
    while not jump.isEmpty():
        if step > most:
            raise ValueError("scopes contain themselves")
        far = out.join(jump.withColumnRenamed("scope", "ancestor"), "ancestor").select("scope", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        grown = cut(out.unionByName(far), "closure")
        further = cut(jump.join(jump.select(F.col("scope").alias("up"), F.col("up").alias("next")), "up").select("scope", F.col("next").alias("up")), "jump")
        free(out, jump)
        out, jump, step = grown, further, 2 * step
    return out


def resolve_names(references: DataFrame, closure: DataFrame, bindings: DataFrame) -> DataFrame:
    """references (ref, scope, name) with the symbol of the nearest enclosing scope that binds the name.

    resolution: resolved; ambiguous where that scope binds it more than once (no symbol then); unresolved.
    """
    per = bindings.groupBy(F.col("scope").alias("ancestor"), "name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol"))
    met = references.join(closure, "scope").join(per, ["ancestor", "name"])
    best = met.groupBy("ref").agg(F.min_by(F.struct("n", "symbol"), "distance").alias("best"))
    out = references.join(best, "ref", "left")
    resolution = F.when(F.col("best").isNull(), "unresolved").when(F.col("best.n") > 1, "ambiguous").otherwise("resolved")
    return out.select(*references.columns, F.when(F.col("best.n") == 1, F.col("best.symbol")).alias("symbol"), resolution.alias("resolution"))


def replay(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Per key: revision (number of events), the last state, and breaks: events whose previous state is not the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("_before", F.lag(state).over(w)).withColumn("_place", F.row_number().over(w))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("revision"), F.max_by(state, "_place").alias("last_state"), F.sum((F.col("_before") == F.col(state)).cast("int")).alias("repeats"))


def first_of_operation(events: DataFrame, operation: list[str], order: list[str]) -> DataFrame:
    """Events without those whose operation was applied before: an operation counts once."""
    return events.withColumn("_place", F.row_number().over(Window.partitionBy(*operation).orderBy(*order))).where("_place = 1").drop("_place")


def violations(events: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Events whose step from the state before (of the same key) is not allowed."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    rows = events.withColumn("from_state", before).where(F.col("from_state").isNotNull())
    fine = None
    for a, b in allowed:
        one = (F.col("from_state") == a) & (F.col(state) == b)
        fine = one if fine is None else fine | one
    return rows if fine is None else rows.where(~fine)


def running(rows: DataFrame, keys: list[str], order: list[str], delta: Column) -> DataFrame:
    """rows with absolute: the sum of deltas so far within keys."""
    return rows.withColumn("absolute", F.sum(delta).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_and_last(rows: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count(F.lit(1)).alias("n"))


def dense_numbers(tokens: DataFrame, key: str, token: str, at: str) -> DataFrame:
    """(key, token, number): tokens of a key numbered from 0 by their first place."""
    first = tokens.groupBy(key, token).agg(F.min(at).alias("first_at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("first_at", token)) - 1)
