"""Validation of sheets by rules that are rows: defaults, repairs, allow-lists by scope, lookups in other sheets, reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.spread import FEW

#: Texts that mean yes.
YES = ("true", "1", "y", "yes", "t")


@dataclass(frozen=True)
class Rule:
    """One row of a rule table, in the order in which they apply.

    kind        column   argument                          a row
    default     x        value                             takes the value where x is blank
    upper       x                                          has x in capitals
    yes_no      x        value where blank                 has x as true or false
    repair      x        values|value                      takes the value where x is none of the values; noted
    clear       x        other=value                       has x false where other is the value; noted
    forget      x        other<>value                      has x null where other is not the value
    required    x                                          is rejected where x is blank
    required_if x        other=value or other=v|w          is rejected where x is blank and other is one of these
    one_of      x        values                            is rejected where x is none of the values
    lower_one_of x       values                            is rejected where x in small letters is none of the values
    one_of_if   x        values, other=value               is rejected where x is none of the values and other is the value
    whole       x                                          is rejected where x is no whole number
    longest     x        n                                 is rejected where x has over n characters
    known       x        table                             is rejected where x is not in the table
    allowed     x        table, by=other                   is rejected where (other, x) is not in the table

    Values are parted by ``|``."""

    kind: str
    column: str
    argument: str = ""
    reason: str = ""


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def split_condition(argument: str) -> Column:
    other, values = argument.split("=", 1)
    return F.coalesce(F.col(other).isin(*values.split("|")), F.lit(False))


def validate_sheet(df: DataFrame, rules: list[Rule], key: list[str], order: str, tables: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with the ``reason`` of the first rule that they break; both with ``repairs``, the reasons of the repairs
    made on them. Of good rows alike in ``key`` without regard to case the first by ``order`` (one of them, if it is the same) stays, the
    others are ``duplicate``.

    All columns but ``order`` are texts without blanks around; rules see what the rules before them made. Tables for ``known`` and
    ``allowed`` are broadcast while they are few, else joined by a shuffle."""
    rows = df.select(*[F.col(c) if c == order else F.trim(F.col(c).cast("string")).alias(c) for c in df.columns]).withColumns({"_repairs": F.array().cast("array<string>"), "_reason": F.lit(None).cast("string")})
    for k, rule in enumerate(rules):
        c, arg = rule.column, rule.argument
        bad = None
        if rule.kind == "default":
            rows = rows.withColumn(c, F.when(blank(c), arg).otherwise(F.col(c)))
        elif rule.kind == "upper":
            rows = rows.withColumn(c, F.upper(c))
        elif rule.kind == "yes_no":
            rows = rows.withColumn(c, F.when(blank(c), arg == "true").otherwise(F.lower(c).isin(*YES)))
        elif rule.kind in ("repair", "clear"):
            if rule.kind == "repair":
                values, to = arg.rsplit("|", 1)
                wrong, new = ~F.coalesce(F.col(c).isin(*values.split("|"), to), F.lit(False)), F.lit(to)
            else:
                wrong, new = split_condition(arg) & F.coalesce(F.col(c), F.lit(False)), F.lit(False)
            noted = F.when(wrong & F.col("_reason").isNull(), F.array_append("_repairs", F.lit(rule.reason))).otherwise(F.col("_repairs"))
            rows = rows.withColumn("_repairs", noted).withColumn(c, F.when(wrong, new).otherwise(F.col(c)))
        elif rule.kind == "forget":
            other, value = arg.split("<>", 1)
            rows = rows.withColumn(c, F.when(F.col(other) == value, F.col(c)))
        elif rule.kind == "required":
            bad = blank(c)
        elif rule.kind == "required_if":
            bad = blank(c) & split_condition(arg)
        elif rule.kind == "one_of":
            bad = ~F.coalesce(F.col(c).isin(*arg.split("|")), F.lit(False))
        elif rule.kind == "lower_one_of":
            bad = ~F.coalesce(F.lower(c).isin(*arg.split("|")), F.lit(False))
        elif rule.kind == "one_of_if":
            values, condition = arg.split(", ", 1)
            bad = ~F.coalesce(F.col(c).isin(*values.split("|")), F.lit(False)) & split_condition(condition)
        elif rule.kind == "whole":
            bad = F.col(c).try_cast("long").isNull()
        elif rule.kind == "longest":
            bad = F.length(c) > int(arg)
        elif rule.kind in ("known", "allowed"):
            name, _, by = arg.partition(", by=")
            found = tables[name]
            columns = [by, c] if by else [c]
            found = found.select(*[F.col(x).alias(f"_{k}_{i}") for i, x in enumerate(found.columns[: len(columns)])]).distinct().withColumn(f"_{k}", F.lit(True))
            found = F.broadcast(found) if found.count() <= FEW else found
            on = [F.col(x) == F.col(f"_{k}_{i}") for i, x in enumerate(columns)]
            rows = rows.join(found, on, "left").withColumn("_miss", F.col(f"_{k}").isNull()).drop(f"_{k}", *[f"_{k}_{i}" for i in range(len(columns))])
            bad = F.col("_miss")
        else:
            raise ValueError(f"no rule of kind {rule.kind}")
        if bad is not None:
            rows = rows.withColumn("_reason", F.coalesce("_reason", F.when(F.coalesce(bad, F.lit(False)), rule.reason))).drop("_miss")
    alike = F.to_json(F.struct(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in key]))
    rows = rows.withColumn("_key", alike)
    good = rows.where("_reason is null")
    first = good.groupBy("_key").agg(F.min(order).alias("_first"))  # combined before the shuffle, so copies are no hot key here
    at = (good["_key"] == first["_key"]) & (good[order] == first["_first"])
    firsts = good.join(first, at, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_key", order).orderBy(F.lit(1))))
    again = good.join(first, at, "left_anti").unionByName(firsts.where("_n > 1").drop("_n")).withColumn("_reason", F.lit("duplicate"))
    firsts = firsts.where("_n = 1").drop("_n")
    out = lambda x: x.withColumnsRenamed({"_reason": "reason", "_repairs": "repairs"}).drop("_key")
    return out(firsts).drop("reason"), out(rows.where("_reason is not null").unionByName(again))
