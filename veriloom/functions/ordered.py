"""Order-dependent results without putting a whole group into one task.

A window over a large group (or over no group at all) sorts that group in a
single task. Here the rows are range-partitioned on (group, order), so a group
of any size is cut into as many pieces as needed. Each piece is processed on its
own, and what it needs from earlier pieces comes from a carry table with at most
two rows per piece.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions.columns import to_long
from veriloom.functions.skew import lookup_join
from veriloom.session import materialize

PIECE = "_piece"
#: Rank error of the sketches that bracket a quantile is one in this many; rows read from all brackets together.
BRACKET_ACCURACY, BRACKET_ROWS = 1_000, 200_000
#: Quantiles asked for at once (columns times probabilities) up to which brackets cost less than one ordered histogram.
BRACKETS = 24
_NUMBER = "_number"


def cut_by_range(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition on ``order`` and number the pieces in that order.

    Range bounds come from a sample and may differ between two runs of the same
    plan, so the numbered rows are written out before they are used twice.
    """
    return materialize(df.repartitionByRange(*order).withColumn(PIECE, F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None,
            totals: dict[str, Column] | None = None) -> DataFrame:
    """Running sums and last non-null values per group, current row included.

    ``totals`` adds sums over the whole group. ``order`` must be unique within a
    group (end it with a row key), or rows of equal order be aggregated before.
    """
    keys, order = list(keys), list(order)
    sums, lasts, totals = sums or {}, lasts or {}, totals or {}
    measures = {f"_m_{n}": c for n, c in {**sums, **lasts, **totals}.items()}
    cut = cut_by_range(df.withColumns(measures), keys + order)

    local = (W.partitionBy(PIECE, *keys).orderBy(*order)
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    here = cut.withColumns({
        **{f"_l_{n}": F.sum(f"_m_{n}").over(local) for n in sums},
        **{f"_l_{n}": F.last(f"_m_{n}", ignorenulls=True).over(local) for n in lasts},
    })
    helper = [PIECE] + [f"_{t}_{n}" for n in (*sums, *lasts, *totals) for t in "mlc"]
    if cut.rdd.getNumPartitions() == 1:
        # all rows fitted one piece, so no group continues elsewhere
        whole = W.partitionBy(PIECE, *keys)
        out = {n: F.col(f"_l_{n}") for n in (*sums, *lasts)}
        out.update({n: F.sum(f"_m_{n}").over(whole) for n in totals})
        return here.withColumns(out).drop(*helper)

    carry = _carry(cut, keys, order, list(sums), list(lasts))
    gkeys = [f"_k{i}" for i in range(len(keys))]
    match = F.col(PIECE) == F.col("_p")
    for k, g in zip(keys, gkeys):
        match = match & F.col(k).eqNullSafe(F.col(g))
    joined = here.join(F.broadcast(carry), match, "left")
    out = {n: F.coalesce(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)), F.col(f"_c_{n}"))
           for n in sums}
    out.update({n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in lasts})
    done = joined.withColumns(out)
    if totals and keys:
        group = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                                       *[F.sum(f"_m_{n}").alias(n) for n in totals])
        done = lookup_join(done, group, keys, F.struct(*order), weight="_rows").drop("_rows")
    elif totals:
        done = done.withColumns({n: cut.agg(F.sum(f"_m_{n}")).scalar() for n in totals})
    return done.drop("_p", *gkeys, *helper)


def _carry(cut: DataFrame, keys: list[str], order: list[str],
           sums: list[str], lasts: list[str]) -> DataFrame:
    """Per piece, totals of the earlier pieces of the group that crosses its start."""
    gkeys = [f"_k{i}" for i in range(len(keys))]
    aggs = [F.sum(f"_m_{n}").alias(f"_s_{n}") for n in sums]
    aggs += [F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.struct(*order))).alias(f"_s_{n}")
             for n in lasts]
    if keys:
        group = F.struct(*[F.col(k) for k in keys])
        edges = cut.groupBy(PIECE).agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))
        crossing = (cut.join(F.broadcast(edges), PIECE)
                    .where(group.eqNullSafe(F.col("_lo")) | group.eqNullSafe(F.col("_hi"))))
        partial = crossing.groupBy(PIECE, *keys).agg(*aggs)
    else:
        partial = cut.groupBy(PIECE).agg(*aggs)
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    return partial.select(
        F.col(PIECE).alias("_p"), *[F.col(k).alias(g) for k, g in zip(keys, gkeys)],
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """row_number() over (partition by keys order by order)."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")})


def row_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int,
              exprs: dict[str, Column], block: int = 100_000) -> DataFrame:
    """Aggregates over the current row and the ``back`` rows before it in its group.

    Rows are numbered, then handled in blocks of ``block`` numbers. Each block
    also gets copies of the ``back`` rows before its start, so a frame never
    leaves its block and no task holds more than block + back rows of a group.
    """
    block = max(block, back + 1)
    numbered = row_numbers(df, keys, order, _NUMBER)
    own = ((F.col(_NUMBER) - 1) / block).cast("long")
    near_end = F.pmod(F.col(_NUMBER) - 1, F.lit(block)) >= block - back
    placed = (numbered.withColumn("_own", own)
              .withColumn("_block", F.explode(F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1))
                                              .otherwise(F.array(F.col("_own"))))))
    frame = W.partitionBy(*keys, "_block").orderBy(_NUMBER).rangeBetween(-back, 0)
    return (placed.withColumns({n: e.over(frame) for n, e in exprs.items()})
            .where(F.col("_block") == F.col("_own")).drop("_own", "_block", _NUMBER))


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
           offsets: Sequence[int], name: str = "{value}_lag{n}", block: int = 100_000) -> DataFrame:
    """Value n rows earlier in the group, for each n in ``offsets``."""
    back = max(offsets)
    block = max(block, back + 1)
    numbered = row_numbers(df, keys, order, _NUMBER)
    own = ((F.col(_NUMBER) - 1) / block).cast("long")
    near_end = F.pmod(F.col(_NUMBER) - 1, F.lit(block)) >= block - back
    placed = (numbered.withColumn("_own", own)
              .withColumn("_block", F.explode(F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1))
                                              .otherwise(F.array(F.col("_own"))))))
    w = W.partitionBy(*keys, "_block").orderBy(_NUMBER)
    cols = {name.format(value=value, n=n): F.lag(value, n).over(w) for n in offsets}
    return (placed.withColumns(cols).where(F.col("_block") == F.col("_own"))
            .drop("_own", "_block", _NUMBER))


def value_counts(df: DataFrame, keys: Sequence[str], value: str,
                 counts: dict[str, Column] | None = None) -> DataFrame:
    """Rows per distinct non-null value (and per group), plus conditional counts."""
    aggs = [F.count(F.lit(1)).alias("n")] + [c.alias(n) for n, c in (counts or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)


def cumulative(hist: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Adds cum_<m>: running sum of each measure of a histogram in ascending value."""
    return running(hist, keys, [value], sums={f"cum_{m}": F.col(m) for m in measures})


def quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float],
              keys: Sequence[str] = (), accuracy: int | None = None, distinct: bool = False) -> DataFrame:
    """Linear-interpolated quantiles of several columns, exact by default.

    Returns one row per group and feature with one column per entry of ``probs``,
    ``n`` (the number of values) and, if asked for, ``distinct_values``. A few
    quantiles of whole columns are found by brackets, others from a histogram
    made with map-side combine; no aggregate holds more than a few numbers per group.
    ``accuracy`` switches to one pass with sketches, off by at most n / accuracy ranks.
    """
    keys, columns = list(keys), list(columns)
    if accuracy is not None:
        out = _sketched(df, columns, probs, keys, accuracy)
        return out if distinct else out.drop("distinct_values")
    if not keys and len(columns) * len(probs) <= BRACKETS:
        out = _bracketed(df, columns, probs)
        return out.join(F.broadcast(_distinct_values(df, columns)), "feature", "left").fillna(0, ["distinct_values"]) if distinct else out
    hist = _histogram(df, columns, keys)
    out = quantiles_of_counts(hist, [*keys, "feature"], "value", "c", probs)
    return out if distinct else out.drop("distinct_values")


def _histogram(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    long = to_long(df, list(keys), list(columns)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("c"))


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _histogram(df, columns).groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))


def _bracketed(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of whole columns, without ordering them.

    One pass of sketches puts each quantile between two values, a second one
    counts the rows below and between them. Brackets that hold few rows are read
    as a histogram of at most BRACKET_ROWS rows for all together, larger ones are
    cut again. The counts prove that the wanted ranks are inside; should they not
    be, or a bracket not shrink, the column is ordered as a whole.
    """
    names = [f"_x{i}" for i in range(len(columns))]
    base = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(x) for c, x in zip(columns, names)])
    eps = 1 / BRACKET_ACCURACY

    def around(lo: float, hi: float) -> list[float]:
        return [max(0.0, lo - 2 * eps), min(1.0, hi + 2 * eps)]

    ends = [e for p in probs.values() for e in around(p, p)]
    row = base.agg(*[F.count(x).alias(f"n{x}") for x in names],
                   *[F.percentile_approx(x, ends, BRACKET_ACCURACY).alias(f"q{x}") for x in names]).first()
    sizes = [row[f"n{x}"] for x in names]
    found: dict[tuple[int, str], float] = {}
    open_: dict[tuple[int, str], list] = {}
    for i, (x, n) in enumerate(zip(names, sizes)):
        for j, (name, p) in enumerate(probs.items()):
            if n:
                at = (n - 1) * p
                open_[i, name] = [at, *row[f"q{x}"][2 * j:2 * j + 2]]
    whole: set[int] = set()
    limit = max(1000, BRACKET_ROWS // max(1, len(open_)))
    while open_:
        def inside(k):
            return F.col(names[k[0]]).between(F.lit(open_[k][1]), F.lit(open_[k][2]))

        order = list(open_)
        row = base.agg(*[c for t, k in enumerate(order) for c in (
            F.count_if(F.col(names[k[0]]) < F.lit(open_[k][1])).alias(f"b{t}"), F.count_if(inside(k)).alias(f"i{t}"))]).first()
        few, many = {}, {}
        for t, k in enumerate(order):
            at, lo, hi = open_[k]
            below, held = row[f"b{t}"], row[f"i{t}"]
            if not (below <= math.floor(at) and math.ceil(at) < below + held):
                whole.add(k[0])
            elif lo == hi:
                found[k] = lo
            else:
                (few if held <= limit else many)[k] = (t, below, held)
        if few:
            rows = F.array(*[F.when(inside(k), F.struct(F.lit(t).alias("t"), F.col(names[k[0]]).alias("v"))) for k, (t, _, _) in few.items()])
            hist: dict[int, list] = {}
            for r in base.where(reduce(or_, map(inside, few))).select(
                    F.inline(F.filter(rows, lambda r: r.isNotNull()))).groupBy("t", "v").count().collect():
                hist.setdefault(r["t"], []).append((r["v"], r["count"]))
            for k, (t, below, _) in few.items():
                at, ranks, total = open_[k][0], [], below
                for v, c in sorted(hist[t]):
                    total += c
                    ranks += [v for want in (math.floor(at), math.ceil(at)) if total - c <= want < total]
                found[k] = ranks[0] + (ranks[-1] - ranks[0]) * (at - math.floor(at))
        if not many:
            break
        cut = base.agg(*[F.percentile_approx(F.when(inside(k), F.col(names[k[0]])), around(
            (math.floor(open_[k][0]) - below) / held, (math.ceil(open_[k][0]) - below) / held), BRACKET_ACCURACY).alias(f"q{t}")
            for k, (t, below, held) in many.items()]).first()
        closer = {k: [open_[k][0], *cut[f"q{t}"]] for k, (t, _, _) in many.items()}
        whole |= {k[0] for k in closer if closer[k] == open_[k]}
        open_ = {k: v for k, v in closer.items() if v != open_[k]}
    schema = "feature string, n long, " + ", ".join(f"`{p}` double" for p in probs)
    out = df.sparkSession.createDataFrame([(c, sizes[i], *[found[i, p] for p in probs]) for i, c in enumerate(columns) if sizes[i] and i not in whole], schema)
    if whole:
        hist = _histogram(df, [columns[i] for i in sorted(whole)])
        out = out.unionByName(quantiles_of_counts(hist, ["feature"], "value", "c", probs).drop("distinct_values"))
    return out


def _sketched(df: DataFrame, columns: list[str], probs: dict[str, float], keys: list[str], accuracy: int) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        x = F.nanvl(F.col(c).cast("double"), F.lit(None))
        aggs += [F.count(x).alias(f"n{i}"), F.approx_count_distinct(x).alias(f"d{i}"),
                 F.percentile_approx(x, list(probs.values()), accuracy).alias(f"q{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("distinct_values"),
                              *[F.col(f"q{i}")[j].alias(p) for j, p in enumerate(probs)]) for i, c in enumerate(columns)])
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(rows))


def quantiles_of_counts(hist: DataFrame, keys: Sequence[str], value: str, count: str,
                        probs: dict[str, float]) -> DataFrame:
    """Exact quantiles from a (group, value, count) histogram."""
    keys = list(keys)
    joined = running(hist, keys, [value], sums={"_cum": F.col(count)},
                     totals={"n": F.col(count), "distinct_values": F.lit(1).cast("long")})
    first, after = F.col("_cum") - F.col(count), F.col("_cum")
    aggs = [F.max(c).alias(c) for c in ("n", "distinct_values")]
    for name, p in probs.items():
        pos = F.col("n").cast("double") - 1.0
        lo, hi = F.floor(pos * p), F.ceil(pos * p)
        aggs.append(F.max(F.when((first <= lo) & (lo < after), F.col(value))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((first <= hi) & (hi < after), F.col(value))).alias(f"_hi_{name}"))
    found = joined.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        pos = (F.col("n").cast("double") - 1.0) * p
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, "n", "distinct_values", *out)


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: n, cumulative count and the mean rank of its ties."""
    cum = cumulative(value_counts(df, keys, value), keys, value, ["n"])
    return cum.withColumn("avg_rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)
