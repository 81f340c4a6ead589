"""Windows over ordered rows whose groups may be of any size.

A group (a document) is cut into segments of a bounded number of rows. Neighbours are looked up inside a segment that is
extended by a few rows on both sides; running values are taken inside a segment and carried over from the segments before
by a window over one row per segment. So no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 16_384


def dense(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Add ``out``: the row's place from 0 inside its group by ``order``; the first order column is a whole number.

    Null order values come first; ties go by the further columns, which should make rows distinct.
    """
    seg = F.expr(f"coalesce({order[0]}, -1) div {SEGMENT}")
    cut = df.withColumn("_seg", seg)
    local = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)) - 1)
    counts = cut.groupBy(*keys, "_seg").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_base", F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    cond = [*keys, "_seg"]
    return local.join(before, cond).withColumn(out, (F.col("_n") + F.col("_base")).cast("bigint")).drop("_seg", "_n", "_base")


def dense_whole(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """The same for groups that each fit a task: one shuffle by the keys, which later windows over them need no more."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def neighbours(df: DataFrame, keys: list[str], values: dict[str, tuple[Column, int]], pos: str = "pos") -> DataFrame:
    """Add, for each name, the value of the row that many places on (negative: back) in the group; null outside of it.

    ``pos`` must be dense.
    """
    reach = max(abs(k) for _, k in values.values())
    spread = F.array_distinct(F.array(*[F.expr(f"({pos} + {d}) div {SEGMENT}") for d in (-reach, 0, reach)]))
    wide = df.withColumn("_seg", F.explode(spread))
    along = Window.partitionBy(*keys, "_seg").orderBy(pos)
    out = wide.select("*", *[(F.lead(c, k) if k > 0 else F.lag(c, -k)).over(along).alias(name) for name, (c, k) in values.items()])
    return out.where(F.col("_seg") == F.expr(f"{pos} div {SEGMENT}")).drop("_seg")


def running_last(df: DataFrame, keys: list[str], values: dict[str, Column], ahead: dict[str, Column] | None = None, before: dict[str, Column] | None = None, pos: str = "pos") -> DataFrame:
    """Add, for each name, the last value that isn't null up to and with the row (``values``), up to the row before
    (``before``), or the next from the row on (``ahead``).

    The frame is read twice, so it should be a table or little work away from one.
    """
    plans = [(n, c, False, 0) for n, c in values.items()] + [(n, c, False, -1) for n, c in (before or {}).items()] + [(n, c, True, 0) for n, c in (ahead or {}).items()]
    cut = df.select("*", F.expr(f"{pos} div {SEGMENT}").alias("_seg"), *[c.alias(f"_v_{n}") for n, c, _, _ in plans])
    side = lambda back: F.desc(pos) if back else F.asc(pos)
    inside = lambda back, to: Window.partitionBy(*keys, "_seg").orderBy(side(back)).rowsBetween(Window.unboundedPreceding, to)
    local = cut.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside(back, to)).alias(f"_l_{n}") for n, _, back, to in plans])
    edge = lambda n, back: (F.min_by if back else F.max_by)(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos)))
    per = cut.groupBy(*keys, "_seg").agg(*[edge(n, back).alias(n) for n, _, back, _ in plans])
    over = lambda back: Window.partitionBy(*keys).orderBy(F.desc("_seg") if back else F.asc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "_seg", *[F.last(n, ignorenulls=True).over(over(back)).alias(f"_c_{n}") for n, _, back, _ in plans])
    out = local.join(carried, [*keys, "_seg"], "left")
    return out.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n, _, _, _ in plans])


def running_sum(df: DataFrame, keys: list[str], values: dict[str, Column], pos: str = "pos") -> DataFrame:
    """Add, for each name, the sum up to and with the row. The frame is read twice."""
    names = list(values)
    cut = df.select("*", F.expr(f"{pos} div {SEGMENT}").alias("_seg"), *[c.cast("bigint").alias(f"_v_{n}") for n, c in values.items()])
    along = Window.partitionBy(*keys, "_seg").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"_v_{n}").over(along).alias(f"_l_{n}") for n in names])
    per = cut.groupBy(*keys, "_seg").agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    over = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "_seg", *[F.sum(n).over(over).alias(f"_c_{n}") for n in names])
    out = local.join(carried, [*keys, "_seg"], "left")
    return out.select(*df.columns, *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in names])


def by_position(parts: Column, pos: str = "pos") -> Column:
    """An array of structs sorted by their position; the structs may hold what has no order of its own, such as maps."""
    return F.array_sort(parts, lambda a, b: F.signum(a[pos] - b[pos]).cast("int"))
