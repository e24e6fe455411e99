"""Table fingerprints, keyed table diffs and desired-versus-actual reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = " <--> "
#: Rows of a list that is broadcast, and shares of the other side that each part of a longer one meets.
SHORT, SHARES = 100_000, 64


def as_text(df: DataFrame, name: str) -> Column:
    """A value as text that does not depend on how an engine prints floating numbers."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.DoubleType | T.FloatType):
        return col.cast("decimal(38,4)").cast("string")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def row_hash(df: DataFrame) -> Column:
    """A 60-bit hash of a whole row; nulls are encoded, so they differ from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("v"), as_text(df, c)), F.lit("n")) for c in df.columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, by: str | None = None) -> DataFrame:
    """num_rows and two checksums that do not depend on the order of rows; one row, or one for each ``by``."""
    h = row_hash(df)
    hashed = df.select(h.alias("h"), *([F.col(by)] if by else []))
    grouped = hashed.groupBy(by) if by else hashed.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("num_rows"), F.coalesce(F.bit_xor("h"), F.lit(0).cast("long")).alias("checksum_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum_sum"),
    )


def fingerprints_match(a: DataFrame, b: DataFrame, by: str | None = None) -> DataFrame:
    """is_matching of the whole tables, or of each group of either."""
    fa, fb = fingerprint(a, by), fingerprint(b, by)
    names = ("num_rows", "checksum_xor", "checksum_sum")
    fa = fa.withColumnsRenamed({c: f"a_{c}" for c in names})
    fb = fb.withColumnsRenamed({c: f"b_{c}" for c in names})
    same = reduce(lambda x, y: x & y, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in names])
    if by is None:
        return fa.join(fb, F.lit(True)).withColumn("is_matching", same)
    fb = fb.withColumnRenamed(by, "_by")
    both = fa.join(fb, F.col(by).eqNullSafe(F.col("_by")), "full")
    return both.withColumn(by, F.coalesce(by, "_by")).drop("_by").withColumn("is_matching", same)


def intersect3(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows only in ``a``, pairs of rows in both (columns of ``b`` get the prefix ``new_``), rows only in ``b``."""
    rest = [c for c in b.columns if c not in keys]
    left = a.withColumn("_a", F.lit(1))
    right = b.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest]).withColumn("_b", F.lit(1))
    both = left.join(right, keys, "full")
    only_a = both.where("_b is null").select(*a.columns)
    only_b = both.where("_a is null").select(*keys, *[F.col(f"new_{c}").alias(c) for c in rest])
    return only_a, both.where("_a is not null and _b is not null").drop("_a", "_b"), only_b


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """New rows come in, common rows take ``cols`` from the update, other rows stay."""
    new = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in target.columns if c not in keys]).withColumn("_b", F.lit(1))
    both = target.withColumn("_a", F.lit(1)).join(new, keys, "full")

    def value(c: str) -> Column:
        taken = F.col("_b").isNotNull() if c in cols else F.col("_a").isNull()
        return F.when(taken, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in target.columns])


def restricted(df: DataFrame, only: DataFrame | None, keys: list[str], multiply: bool = False) -> DataFrame:
    """Rows whose key is listed. A key listed twice multiplies rows only if asked for."""
    if only is None:
        return df
    return df.join(only.select(*keys), keys, "inner" if multiply else "left_semi")


def _paired(prev: DataFrame, curr: DataFrame, keys: list[str], only: DataFrame | None) -> tuple[DataFrame, list[str]]:
    rest = [c for c in prev.columns if c not in keys]
    p, c = (restricted(x, only, keys) for x in (prev, curr))
    left = p.select(*[F.col(k).alias(f"p_{k}") for k in keys], *[F.col(x).alias(f"p_{x}") for x in rest], *[as_text(p, x).alias(f"pt_{x}") for x in rest])
    right = c.select(*[F.col(k).alias(f"c_{k}") for k in keys], *[F.col(x).alias(f"c_{x}") for x in rest], *[as_text(c, x).alias(f"ct_{x}") for x in rest])
    on = reduce(lambda x, y: x & y, [F.col(f"p_{k}") == F.col(f"c_{k}") for k in keys])
    return left.join(right, on, "full"), rest


def diff_wide(prev: DataFrame, curr: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """Keys, change_type and, for each other column, ``previous <--> current`` or ''.

    Added is tested first on the first key, so a row with a null key counts as added."""
    both, rest = _paired(prev, curr, keys, only)
    differs = {c: ~F.col(f"p_{c}").eqNullSafe(F.col(f"c_{c}")) for c in rest}
    kind = F.when(F.col(f"p_{keys[0]}").isNull(), "Added").when(F.col(f"c_{keys[0]}").isNull(), "Deleted").otherwise("Changed")
    show = lambda c: F.concat(F.coalesce(f"pt_{c}", F.lit("NULL")), F.lit(ARROW), F.coalesce(f"ct_{c}", F.lit("NULL")))
    unlike = reduce(lambda x, y: x | y, differs.values(), F.lit(False))
    return both.where(unlike | F.col(f"p_{keys[0]}").isNull() | F.col(f"c_{keys[0]}").isNull()).select(
        *[F.coalesce(f"c_{k}", f"p_{k}").alias(k) for k in keys], kind.alias("change_type"), *[F.when(d, show(c)).otherwise("").alias(c) for c, d in differs.items()]
    )


def diff_list(prev: DataFrame, curr: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """One row for each changed cell, compared as text: keys, change_type, changed_column, previous_value, current_value."""
    both, rest = _paired(prev, curr, keys, only)
    kind = F.when(F.col(f"p_{keys[0]}").isNull(), "Added").when(F.col(f"c_{keys[0]}").isNull(), "Deleted").otherwise("Changed")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"pt_{c}").alias("prev"), F.col(f"ct_{c}").alias("curr")) for c in rest])
    changed = F.filter(cells, lambda x: ~x["prev"].eqNullSafe(x["curr"]))
    rows = both.select(*[F.coalesce(f"c_{k}", f"p_{k}").alias(k) for k in keys], kind.alias("change_type"), F.explode(changed).alias("x"))
    null = F.lit("NULL")
    return rows.select(
        *keys, "change_type", F.col("x.col").alias("changed_column"),
        F.coalesce("x.prev", null).alias("previous_value"), F.coalesce("x.curr", null).alias("current_value"),
    )


def union_key_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct().agg(F.count(F.lit(1)).alias("total_keys"))


def diff_summary(prev: DataFrame, curr: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """total_keys, added, deleted, changed, unchanged, cell_diffs in one pass over the joined tables."""
    both, rest = _paired(prev, curr, keys, only)
    added, deleted = F.col(f"p_{keys[0]}").isNull(), F.col(f"c_{keys[0]}").isNull()
    differs = [~F.col(f"pt_{c}").eqNullSafe(F.col(f"ct_{c}")) for c in rest]
    cells = reduce(lambda x, y: x + y, [d.cast("int") for d in differs], F.lit(0))
    typed = reduce(lambda x, y: x | y, [~F.col(f"p_{c}").eqNullSafe(F.col(f"c_{c}")) for c in rest], F.lit(False))
    key = F.struct(*[F.coalesce(f"c_{k}", f"p_{k}") for k in keys])
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = both.select(key.alias("k"), added.alias("a"), (~added & deleted).alias("d"), (~added & ~deleted & typed).alias("c"), cells.alias("n"))
    out = sums.groupBy("k").agg(*[count(F.col(x)).alias(x) for x in "adcn"]).agg(
        F.count(F.lit(1)).alias("total_keys"), count(F.col("a")).alias("added"), count(F.col("d")).alias("deleted"),
        count(F.col("c")).alias("changed"), count(F.col("n")).alias("cell_diffs"),
    )
    return out.withColumn("unchanged", F.expr("total_keys - added - deleted - changed"))


VOID = "array<struct<mismatch_type:string,property:string,desired_value:string,actual_value:string>>"


def reconcile(desired: DataFrame, actual: DataFrame, keys: list[str], props: list[str] = ()) -> DataFrame:
    """Keys with mismatch_type MISSING (desired, not there), EXTRA (there, not desired) or, where a property
    differs (null is ''), PROPERTY with its name and both values."""
    side = lambda df, tag: df.select(*[F.col(k).alias(f"{tag}k_{k}") for k in keys], F.lit(1).alias(f"{tag}in"), *[F.coalesce(as_text(df, p), F.lit("")).alias(f"{tag}{p}") for p in props])
    both = side(desired, "d_").join(side(actual, "a_"), reduce(lambda x, y: x & y, [F.col(f"d_k_{k}") == F.col(f"a_k_{k}") for k in keys]), "full")
    cell = lambda kind, p=None, d=None, a=None: F.struct(*[(F.lit(None).cast("string") if x is None else x).alias(n) for n, x in (("mismatch_type", F.lit(kind)), ("property", p), ("desired_value", d), ("actual_value", a))])
    unlike = F.filter(F.array(*[cell("PROPERTY", F.lit(p), F.col(f"d_{p}"), F.col(f"a_{p}")) for p in props]), lambda x: x["desired_value"] != x["actual_value"]) if props else F.array().cast(VOID)
    found = F.when(F.col("a_in").isNull(), F.array(cell("MISSING"))).when(F.col("d_in").isNull(), F.array(cell("EXTRA"))).otherwise(unlike)
    return both.select(*[F.coalesce(f"d_k_{k}", f"a_k_{k}").alias(k) for k in keys], F.explode(found).alias("x")).select(*keys, "x.*")


def remediation(mismatches: DataFrame, templates: dict[str, str]) -> DataFrame:
    """command: the template of the mismatch type with ``{column}`` filled in; types without one give null."""
    out = F.lit(None).cast("string")
    for kind, text in templates.items():
        filled = F.lit(text)
        for c in mismatches.columns:
            filled = F.replace(filled, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
        out = F.when(F.col("mismatch_type") == kind, filled).otherwise(out)
    return mismatches.withColumn("command", out)


def missing_from_product(left: DataFrame, right: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    """Every pairing of ``left`` with the list ``right`` that ``current`` lacks; distinct, nulls equal. The list is broadcast while it is
    short; a long one is dealt to parts, and each share of ``left`` meets each part."""
    parts = -(-right.count() // SHORT) or 1
    if parts == 1:
        pairs = left.join(F.broadcast(right), F.lit(True))
    else:
        dealt = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int"))
        pairs = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_share", F.pmod(F.xxhash64(*left.columns), F.lit(SHARES)).cast("int"))
        pairs = pairs.join(dealt.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["_part", "_share"])
    return pairs.select(*cols).subtract(current.select(*cols))


def deny_conflicts(perms: DataFrame, who: list[str], scopes: list[list[str]], state: str = "state") -> DataFrame:
    """Grants that a denial overrides. ``scopes``: for each scope, widest first, the columns on which the
    denial must agree, without regard to case; the first that holds is named in ``deny_scope``."""
    grants = perms.where(F.upper(state) != "DENY")
    out, found = grants, F.lit(None).cast("int")
    for k, cols in enumerate(scopes):
        on = [*who, *cols]
        deny = perms.where(F.upper(state) == "DENY").select(*[F.lower(F.col(c).cast("string")).alias(f"_{k}_{c}") for c in on], F.lit(k).alias(f"_hit{k}")).distinct()
        out = out.join(deny, reduce(lambda x, y: x & y, [F.lower(F.col(c).cast("string")) == F.col(f"_{k}_{c}") for c in on]), "left")
        found = F.coalesce(found, F.col(f"_hit{k}"))
    return out.withColumn("deny_scope", found).where("deny_scope is not null").select(*perms.columns, "deny_scope")
