"""Running values over ordered rows of groups of any length.

A window puts a group into one task. Where the longest group has more rows than a task should take, the rows are cut into
ranges of (group, order) instead. Each range is scanned on its own, and what it leaves behind (a sum, a maximum, its first and
last value) is carried to the ranges of the group that follow. Only groups that lie in more than one range have a carry,
so there are at most twice as many as ranges, and these are broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.shared import written

#: Rows of a group that one task takes.
LONG_GROUP = 2_000_000

#: Running values up to and with a row, up to the one before, and of the neighbours.
KINDS = ("sum", "max", "min", "sum_before", "max_before", "min_before", "lag", "lead")


class Ordered:
    """Rows in order within groups, to which running values are added.

    ``by`` may be empty; ``order_by`` ascends, nulls first, and should tell the rows of a group apart. Nulls of ``by`` are one group."""

    def __init__(self, df: DataFrame, by: list[str], order_by: list[str], long_group: int = LONG_GROUP):
        self.by, self.order_by, self.rows = by, order_by, df
        longest, total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        self.cut = (longest or 0) > long_group
        if self.cut:
            n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // long_group))
            self.rows = written(df.repartitionByRange(n, *by, *order_by).withColumn("_range", F.spark_partition_id()), "ranges")

    def add(self, **measures: tuple[str, Column]) -> Ordered:
        """New columns by name, each of a kind (of KINDS) and a value; a value may use columns added before."""
        out = Ordered.__new__(Ordered)
        out.by, out.order_by, out.cut = self.by, self.order_by, self.cut
        out.rows = self._scanned(measures) if self.cut else self.rows.withColumns({name: self._local(kind, x, self.by) for name, (kind, x) in measures.items()})
        return out

    def done(self, *drop: str) -> DataFrame:
        return self.rows.drop("_range", *drop)

    def _local(self, kind: str, x: Column, by: list[str]) -> Column:
        order = Window.partitionBy(*by).orderBy(*self.order_by)
        if kind in ("lag", "lead"):
            return getattr(F, kind)(x).over(order)
        upto = order.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("_before") else 0)
        return getattr(F, kind.removesuffix("_before"))(x).over(upto)

    def _scanned(self, measures: dict[str, tuple[str, Column]]) -> DataFrame:
        place = F.struct(*self.order_by)
        left, carried, local = [], {}, {}
        ranges = Window.partitionBy(*[f"_by_{c}" for c in self.by]).orderBy("_of")
        before = ranges.rowsBetween(Window.unboundedPreceding, -1)
        for name, (kind, x) in measures.items():
            if kind in ("lag", "lead"):  # in a struct, a null value differs from no value
                local[f"_l_{name}"] = self._local(kind, F.struct(x.alias("x")), [*self.by, "_range"])
                left.append((F.max_by if kind == "lag" else F.min_by)(F.struct(x.alias("x")), place).alias(f"_s_{name}"))
                carried[f"_c_{name}"] = getattr(F, kind)(f"_s_{name}").over(ranges)
            else:
                fold = getattr(F, kind.removesuffix("_before"))
                local[f"_l_{name}"] = self._local(kind, x, [*self.by, "_range"])
                left.append(fold(x).alias(f"_s_{name}"))
                carried[f"_c_{name}"] = fold(f"_s_{name}").over(before)
        spans = self.rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in self.by], F.col("_range").alias("_of")).agg(*left)
        pieces = F.count(F.lit(1)).over(Window.partitionBy(*[f"_by_{c}" for c in self.by]))
        spans = spans.withColumns({**carried, "_pieces": pieces}).where("_pieces > 1").select(*[f"_by_{c}" for c in self.by], "_of", *carried)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in self.by], F.col("_range") == F.col("_of"))
        met = self.rows.withColumns(local).join(F.broadcast(spans), same, "left")
        for name, (kind, _) in measures.items():
            here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            if kind in ("lag", "lead"):
                value = F.coalesce(here, carry)["x"]
            elif kind.startswith("sum"):
                value = F.coalesce(here + carry, here, carry)
            else:
                value = (F.greatest if kind.startswith("max") else F.least)(here, carry)
            met = met.withColumn(name, value)
        return met.drop("_of", *[f"_by_{c}" for c in self.by], *local, *carried)
