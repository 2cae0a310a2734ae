"""Imputation by nearest rows: branch and bound over a pyramid of donor counts, also for rows with unknown features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.skew import lookup_join
from veriloom.session import stored

#: Bits of a cell number at most; cells are halved no further.
FINEST = 48
#: Donor points a finest cell should hold at most.
LEAF = 8


def _total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _squares(differences: Sequence[Column]) -> Column:
    """Sum of squares; a feature outside the common ones is null and adds nothing."""
    return _total([F.coalesce(d * d, F.lit(0.0)) for d in differences])


class _Pyramid:
    """Cells of donor points at halving widths.

    A point has a whole number per feature at the finest width; shifting it to the
    right gives its cell at any wider one. A cell knows how many donors it holds and
    the box around them, so distances to it are bounded without rounding errors.
    """

    def __init__(self, points: DataFrame, features: int, leaf: int):
        self.axes = range(features)
        self.step = max(1, 4 // features)
        ends = points.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in self.axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
        width = max([ends[f"hi{i}"] - ends[f"lo{i}"] for i in self.axes if ends[f"lo{i}"] is not None], default=0.0) or 1.0
        last = F.lit((1 << FINEST) - 1)
        place = {f"c{i}": F.coalesce(F.least(last, F.floor((F.col(f"x{i}") - F.lit(ends[f"lo{i}"])) / width * float(1 << FINEST))), F.lit(0)).cast("long")
                 for i in self.axes}
        placed = points.withColumns(place)
        few, many = 0, FINEST // self.step  # the first level whose fullest cell is small enough lies between them
        while few < many:
            tried = sorted({few + (many - few) * i // 5 for i in range(5)})
            cells = placed.withColumn("level", F.explode(F.array(*[F.lit(t) for t in tried]))).select(
                "g", "level", *[F.expr(f"shiftright(c{i}, {FINEST} - {self.step} * level)").alias(f"c{i}") for i in self.axes])
            held = cells.groupBy("g", "level", *[f"c{i}" for i in self.axes]).agg(F.count(F.lit(1)).alias("n"))
            fullest = dict(held.groupBy("level").agg(F.max("n")).collect())  # a row a level
            few, many = max([few, *(t + 1 for t in tried if fullest.get(t, 0) > leaf)]), min([many, *(t for t in tried if fullest.get(t, 0) <= leaf)])
        self.depth = few * self.step
        self.points = placed.select("g", "donors", *[f"x{i}" for i in self.axes], *self._cells(self.depth))
        level = F.explode(F.array(*[F.lit(n) for n in range(0, self.depth + 1, self.step)]))
        at = placed.withColumn("level", level)
        cells = [F.expr(f"shiftright(c{i}, {FINEST} - level)").alias(f"c{i}") for i in self.axes]
        boxes = [f(f"x{i}").alias(f"{n}{i}") for i in self.axes for n, f in (("lo", F.min), ("hi", F.max))]
        self.counts = stored(at.select("g", "level", F.size("donors").alias("n"), *[f"x{i}" for i in self.axes], *cells)
                             .groupBy("g", "level", *[f"c{i}" for i in self.axes]).agg(F.sum("n").alias("n"), *boxes), "knn_pyramid")

    def _cells(self, level: int) -> list[Column]:
        return [F.shiftright(f"c{i}", FINEST - level).alias(f"c{i}") for i in self.axes]

    def _nearest_cells(self, met: DataFrame, k: int) -> DataFrame:
        """Cells that can hold one of a query's k nearest: no farther than the cells that hold k donors reach."""
        near = [F.greatest(F.col(f"lo{i}") - F.col(f"q{i}"), F.col(f"q{i}") - F.col(f"hi{i}"), F.lit(0.0)) for i in self.axes]
        far = [F.greatest(F.col(f"q{i}") - F.col(f"lo{i}"), F.col(f"hi{i}") - F.col(f"q{i}")) for i in self.axes]
        inside = [F.when(F.col(f"q{i}").isNotNull() & F.col(f"lo{i}").isNotNull(), d) for i, d in enumerate(near)]
        outside = [F.when(F.col(f"q{i}").isNotNull() & F.col(f"lo{i}").isNotNull(), d) for i, d in enumerate(far)]
        reach = met.withColumns({"near": _squares(inside) * F.col("weight"), "far": _squares(outside) * F.col("weight")})
        held = F.sum("n").over(W.partitionBy("query").orderBy("far"))
        bound = F.min(F.when(F.col("held") >= k, F.col("far"))).over(W.partitionBy("query"))
        return (reach.withColumn("held", held).withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
                .select("query", "g", "weight", *[f"q{i}" for i in self.axes], *[f"c{i}" for i in self.axes]))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, distance, donors) for the points of all cells that can hold one of the k nearest donors of (query, g, weight, q0, q1, …)."""
        found = queries.withColumns({f"c{i}": F.lit(0).cast("long") for i in self.axes})
        for level in range(self.step, self.depth + 1, self.step):
            below = self.counts.where(F.col("level") == level).drop("level")
            parents = [F.shiftright(f"c{i}", self.step).alias(f"p{i}") for i in self.axes]
            below = below.select("g", "n", *parents, *[f"{n}{i}" for i in self.axes for n in ("c", "lo", "hi")])
            above = found.select("query", "g", "weight", *[f"q{i}" for i in self.axes], *[F.col(f"c{i}").alias(f"p{i}") for i in self.axes])
            found = stored(self._nearest_cells(above.join(below, ["g", *[f"p{i}" for i in self.axes]]), k), "knn_cells")
        apart = _squares([F.col(f"x{i}") - F.col(f"q{i}") for i in self.axes]) * F.col("weight")
        return found.join(self.points, ["g", *[f"c{i}" for i in self.axes]]).select("query", apart.alias("distance"), "donors")


def knn_impute(df: DataFrame, target: str, features: Sequence[str], key: str, k: int = 5, leaf: int = LEAF) -> DataFrame:
    """Fills nulls of ``target`` from the k nearest rows over ``features``: their mean, of a string column their most frequent value.

    The distance of two rows is Euclidean over the features known in both, times
    the root of (all features / common ones); rows without a common feature are no
    neighbours. Ties go to the smaller key, of values to the smaller value. With
    fewer than k donors those there are count; a row that has no neighbour gets the
    mean (most frequent value) of the column. NaN is unknown. Keys are unique.

    Rows to fill are collapsed to distinct feature points. Donors are grouped by
    which of their features are known and, of these, known in the query; in a
    group a point keeps k donors. All groups share one pyramid of cells: a query
    starts with the whole space and goes down level by level to the cells that can
    still hold one of its k nearest, so what it meets depends on k and the number
    of features, not on how rows are spread or how far an outlier lies.
    """
    feats, n = list(features), len(features)
    known = {f"x{i}": F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for i, f in enumerate(feats)}
    kind = df.schema[target].dataType
    text = isinstance(kind, T.StringType)
    value = F.col(target) if text else F.col(target).cast("double")
    value = value if text else F.when(~F.isnan(value), value)
    xs = [f"x{i}" for i in range(n)]
    pattern = _total([F.col(x).isNotNull().cast("int") * (1 << i) for i, x in enumerate(xs)]).alias("pattern")
    rows = df.select(*[c.alias(x) for x, c in known.items()], value.alias("t"), F.col(key).alias("id")).select("*", pattern)
    name = F.to_json(F.struct(*[c.alias(x) for x, c in known.items()]))
    queries = rows.where("t is null and pattern > 0").select(F.to_json(F.struct(*xs)).alias("query"), "pattern", *xs).distinct()
    donors = rows.where("t is not null and pattern > 0")

    seen = rows.where("pattern > 0").groupBy("pattern", F.col("t").isNull().alias("open")).count().collect()  # at most 2^features patterns on each side
    asked, given = ([r["pattern"] for r in seen if r["open"] == side] for side in (True, False))
    routes = sorted({(p, q, p & q) for p in given for q in asked if p & q})
    spark = df.sparkSession

    def projected(prefix: str) -> list[Column]:
        return [F.when(F.col("common").bitwiseAND(1 << i) != 0, F.col(f"x{i}")).alias(f"{prefix}{i}") for i in range(n)]

    group = (F.col("pattern") * (1 << n) + F.col("common")).cast("long")
    to_groups = F.broadcast(spark.createDataFrame(sorted({(p, s) for p, _, s in routes}), "pattern int, common int"))

    def first_at(points: DataFrame, keys: Sequence[str]) -> DataFrame:
        return points.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= k).drop("r")

    here = first_at(donors, ["pattern", *xs]).join(to_groups, "pattern").select(group.alias("g"), "id", "t", *projected("x"))
    points = first_at(here, ["g", *xs]).groupBy("g", *xs).agg(F.sort_array(F.collect_list(F.struct("id", "t"))).alias("donors"))  # k at most
    points = stored(points, "knn_points")
    fallback = F.mode("t", deterministic=True) if text else F.avg("t")
    column = rows.where("t is not null").agg(fallback.alias("v")).scalar()
    filled = None
    if routes:
        pyramid = _Pyramid(points, n, leaf)
        wanted = F.broadcast(spark.createDataFrame([(q, p, s, n / s.bit_count()) for p, q, s in routes], "asked int, pattern int, common int, weight double"))
        spread = queries.withColumnRenamed("pattern", "asked").join(wanted, "asked").select("query", group.alias("g"), "weight", *projected("q"))
        near = pyramid.search(spread, k).select("query", "distance", F.inline("donors"))
        best = near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))).where(F.col("r") <= k)
        filled = best.groupBy("query").agg((F.mode("t", deterministic=True) if text else F.avg("t")).alias("_fill"))
    out = df.withColumn("_query", F.when(value.isNull(), name))
    out = lookup_join(out, filled.withColumnRenamed("query", "_query"), ["_query"], key) if filled is not None else out.withColumn("_fill", F.lit(None))
    fill = F.coalesce("_fill", F.when(value.isNull(), column))
    return out.withColumn(target, F.coalesce(F.when(value.isNotNull(), F.col(target)), fill if text else fill.cast("double"))).select(*df.columns)
