"""Names of database objects: quoting, and names that no other has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.scan import LONG_GROUP, Ordered
from sparkloom.shared import written

#: Fixed value: the longest name.
LONGEST = 128
ROUNDS = 100


def object_name(text: Column) -> Column:
    """Letters, digits and single underscores between them; ``obj`` where nothing is left."""
    safe = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_]+", "_")
    safe = F.regexp_replace(F.regexp_replace(safe, "__+", "_"), "^_|_$", "")
    return F.when(safe == "", "obj").otherwise(safe)


def bracketed(name: Column) -> Column:
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def literal(text: Column) -> Column:
    """A text between single quotes, those inside doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def unique_names(df: DataFrame, base: str, order: str, used: DataFrame | None = None, longest: int = LONGEST, long_group: int = LONG_GROUP) -> DataFrame:
    """``df`` with ``name``: row by row in ``order`` (unique), the first of base, base_2, base_3 and so on that neither an earlier row nor
    ``used(name)`` has.

    In rounds: each row asks for a name, of those that ask for one the earliest gets it, and the others ask for their next. Rows of one
    base want the same names, so each begins behind those before it, and who is turned away pushes on those behind; a round more
    is needed only where bases meet each other's numbers. A base is cut so that its number fits."""
    k = F.col("_k").cast("string")
    wanted = F.when(F.col("_k") == 1, F.substring(base, 1, longest)).otherwise(F.concat(F.col(base).substr(F.lit(1), (longest - 1 - F.length(k)).cast("int")), F.lit("_"), k))
    rows = df.withColumn(base, F.substring(base, 1, longest))
    rows = written(Ordered(rows, [base], [order], long_group).add(_k=("sum", F.lit(1).cast("long"))).done(), "names")
    for _ in range(ROUNDS):
        asked = rows.withColumn("name", wanted)
        first = asked.groupBy("name").agg(F.min(order).alias("_first"))
        met = asked.join(first, "name")
        if used is not None:
            met = met.join(used.select("name", F.lit(True).alias("_used")).distinct(), "name", "left")
        else:
            met = met.withColumn("_used", F.lit(None).cast("boolean"))
        met = written(met.withColumn("_away", (F.coalesce("_used", F.lit(False)) | (F.col(order) != F.col("_first"))).cast("long")).drop("_first", "_used"), "names")
        if not met.where("_away > 0").limit(1).count():
            return met.select(*df.columns, "name")
        # _k less the place in the base is how far a row was pushed; those behind are pushed as far at least
        placed = Ordered(met.drop("name"), [base], [order], long_group).add(_n=("sum", F.lit(1).cast("long")))
        placed = placed.add(_push=("max", F.col("_k") + F.col("_away") - F.col("_n")))
        rows = written(placed.done().withColumn("_k", F.col("_n") + F.col("_push")).drop("_n", "_push", "_away"), "names")
    raise RuntimeError(f"names still clash after {ROUNDS} rounds")
