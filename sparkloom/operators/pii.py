"""Personal data: finding columns, keyed pseudonyms, mappings and their reversal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.spread import FEW

# What mail addresses, numbers and dates look like.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?\d[\d ().-]{6,}\d$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
DATE = r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})$"


def joined(heads: str, tails: str) -> tuple[str, ...]:
    return tuple((a + b).capitalize() for a in heads.split() for b in tails.split())


#: Names by a rule: each head with each tail, 256 first and last names and 64 places.
FIRST = joined("al an be ca da el fe ga io jo ka le mi no re sa", "bin da dor fi gan ko lan mar nis ra sel ta vin xa ya zo")
LAST = joined("ash black bright clear cold deep elm fair gold green high long oak red stone white", "brook cliff dale fall field ford frost gate hill lake marsh moor reed ridge vale wood")
CITIES = joined("east high low mid new north south west", "bury ford gate ham moor stead town wick")


def detect_pii(df: DataFrame, order: str, n: int = 20) -> list[str]:
    """Text columns of whose first ``n`` values in the order over half look like mail, phone or social security
    numbers. Each column keeps its least ``n`` (order, value) pairs, so one pass suffices."""
    names = [c for c, k in df.dtypes if k == "string"]
    if not names:
        return []
    long = df.select(F.col(order).alias("_order"), *names).unpivot("_order", names, "column", "value").where("value is not null")
    from pyspark.sql import Window

    first = long.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("_order", "value"))).where(F.col("_n") <= n)
    phone = F.col("value").rlike(PHONE) & ~F.col("value").rlike(DATE)
    like = F.col("value").rlike(EMAIL) | phone | F.col("value").rlike(SSN)
    return sorted(r.column for r in first.groupBy("column").agg(F.avg(like.cast("int")).alias("p")).where("p > 0.5").collect())


def hmac_hex(value: Column, key: str) -> Column:
    """HMAC-SHA256 in built-in functions; the padded keys are constants."""
    import hashlib

    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "utf-8")), 256))), 256)


def modulo(digest: Column, n: int) -> Column:
    """A digest of up to 256 bits modulo ``n``, eight digits at a time; the digest is made once."""
    def folded(d: Column) -> Column:
        acc = F.lit(0).cast("long")
        for at in range(1, 65, 8):
            acc = (acc * (16**8 % n) + F.conv(F.substring(d, at, 8), 16, 10).cast("long")) % n
        return acc

    return F.get(F.transform(F.array(F.lpad(digest, 64, "0")), folded), F.lit(0))


def column_kind(name: str) -> str | None:
    """What a column holds, by its name alone."""
    plain = re.sub(r"[^a-z]", "", name.lower())
    for kind, words in (
        ("first", ("firstname", "givenname")), ("last", ("lastname", "surname", "familyname")), ("birth", ("birth", "dob")), ("address", ("address", "street")),
        ("city", ("city", "town")), ("state", ("state", "province")), ("country", ("country", "nation")), ("zip", ("zip", "postal", "postcode")),
    ):
        if any(w in plain for w in words):
            return kind
    return "id" if plain == "id" or name.lower().endswith(("_id", "id_")) else None


def pick(pool: tuple[str, ...], digest: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (modulo(digest, len(pool)) + 1).cast("int"))


def digits(digest: Column, n: int) -> Column:
    """``n`` decimal digits from a digest."""
    return F.left(F.translate(F.concat(digest, F.sha2(digest, 256)), "abcdef", "012345"), F.lit(n))


def keep_shape(value: Column, digest: Column) -> Column:
    """Digits replaced one by one, all else as it was."""
    chars, new = F.split(value, ""), F.slice(F.split(digits(digest, 64), ""), 1, 64)
    new = F.flatten(F.array_repeat(new, F.ceil(F.char_length(value) / 64).cast("int") + 1))
    return F.array_join(F.zip_with(chars, F.slice(new, F.lit(1), F.size(chars)), lambda c, d: F.when(c.between("0", "9"), d).otherwise(c)), "")


def fake_date(value: Column, digest: Column) -> Column:
    """A day of the 36,500 from 1970 on, with the order and separator of the value."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), modulo(digest, 36_500).cast("int"))
    sep = F.regexp_extract(value, "([-/])", 1)
    plain = F.when(value.rlike("^[0-9]{4}"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM-dd-yyyy"))
    return F.replace(plain, F.lit("-"), sep)


def token(value: Column, name: str, key: str) -> Column:
    """The pseudonym of a value, by the kind of its column and then by its look; null stays null."""
    d = hmac_hex(value, key)
    kind = column_kind(name)
    by_name = {
        "id": F.left(d, F.lit(18)), "first": pick(FIRST, d), "last": pick(LAST, d), "city": pick(CITIES, d), "state": pick(CITIES, F.sha2(d, 256)), "country": pick(CITIES, F.reverse(d)),
        "zip": digits(d, 5), "birth": fake_date(value, d), "address": F.concat(digits(d, 3), F.lit(" "), pick(LAST, d), F.lit(" Street")),
    }
    mail = F.concat(F.lower(pick(FIRST, d)), F.lit("."), F.lower(pick(LAST, F.reverse(d))), digits(d, 4), F.lit("@example.org"))
    out = by_name["id"] if kind == "id" else (
        F.when(value.rlike(EMAIL), mail).when(value.rlike(SSN), keep_shape(value, d))
        .otherwise(by_name[kind] if kind else F.when(value.rlike(PHONE) & ~value.rlike(DATE), keep_shape(value, d))
                   .when(value.rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+)+$"), F.concat(pick(FIRST, d), F.lit(" "), pick(LAST, d))).when(value.rlike(DATE), fake_date(value, d)).otherwise(F.left(d, F.lit(16))))
    )
    return F.when(value.isNotNull(), out)


def apart(mapping: DataFrame, key: str, old: DataFrame | None = None) -> DataFrame:
    """``mapping`` with one token for each original of a column: of tokens that several have, or that an older mapping has
    given, digits of each original's digest make its own."""
    every = mapping.select("column", "token") if old is None else mapping.select("column", "token").unionByName(old.select("column", "token"))
    shared = every.groupBy("column", "token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumnsRenamed({"column": "_c", "token": "_t"})
    own = F.left(hmac_hex(F.col("original"), key), F.lit(24))
    told = F.when(F.contains("token", F.lit("@")), F.replace("token", F.lit("@"), F.concat(F.lit("."), own, F.lit("@")))).otherwise(F.concat("token", F.lit("-"), own))
    joined = mapping.join(shared, (F.col("column") == F.col("_c")) & (F.col("token") == F.col("_t")), "left")
    return joined.select("column", "original", F.when(F.col("_n").isNull(), F.col("token")).otherwise(told).alias("token"))


def build_mapping(df: DataFrame, cols: list[str], key: str, old: DataFrame | None = None) -> DataFrame:
    """column, original, token of each distinct value; tokens of an older mapping win, and no two originals share one."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("original")).where("original is not null").distinct().withColumn("token", token(F.col("original"), c, key)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if old is None:
        return apart(out, key)
    return old.select("column", "original", "token").unionByName(apart(out.join(old, ["column", "original"], "left_anti"), key, old))


def pseudonymize(df: DataFrame, cols: list[str], key: str, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with tokens, and the mapping. Tokens are expressions on the rows; only where the mapping has another one, as
    it is older or was told apart, the rows look it up."""
    mapping = build_mapping(df, cols, key, old).checkpoint()
    plain = F.lit(False)
    for c in cols:
        plain = plain | ((F.col("column") == c) & (F.col("token") == token(F.col("original"), c, key)))
    other = mapping.where(~plain)
    looked_up = apply_mapping(df.withColumns({f"_as_{c}": token(F.col(c).cast("string"), c, key) for c in cols}), other, cols, "original", "token", {c: F.col(f"_as_{c}") for c in cols})
    return looked_up.drop(*[f"_as_{c}" for c in cols]), mapping


def apply_mapping(df: DataFrame, mapping: DataFrame, cols: list[str], source: str, target: str, otherwise: dict[str, Column] | None = None) -> DataFrame:
    """Values replaced by what the mapping says, others by ``otherwise`` or left; a mapping of few rows is broadcast."""
    few = mapping.count() <= FEW
    for c in cols:
        own = mapping.where(F.col("column") == c).select(F.col(source).alias("_from"), F.col(target).alias("_to"))
        rest = (otherwise or {}).get(c, F.col(c).cast("string"))
        df = df.join(F.broadcast(own) if few else own, F.col(c).cast("string") == F.col("_from"), "left").withColumn(c, F.coalesce("_to", rest)).drop("_from", "_to")
    return df


def random_mapping(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, original, token: one random token a distinct value, written to the checkpoint folder before use, so
    that a task run again can't give others."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "original")
    return long.where("original is not null").distinct().withColumn("token", F.uuid()).checkpoint()


def row_mail_mapping(df: DataFrame, mail: str, first: str, last: str, order: str, key: str) -> DataFrame:
    """column, original, token: addresses made of the pseudonyms of the names in the first row, by ``order``, that
    holds the address. A missing name gives ``user``; equal names are told apart by four digits of the digest."""
    named = F.struct(token(F.col(first).cast("string"), "first_name", key).alias("f"), token(F.col(last).cast("string"), "last_name", key).alias("l"))
    one = df.where(F.col(mail).isNotNull()).groupBy(F.col(mail).cast("string").alias("original")).agg(F.min_by(named, order).alias("n"))
    name = F.lower(F.coalesce(F.nullif(F.concat_ws(".", "n.f", "n.l"), F.lit("")), F.lit("user")))
    made = one.select(F.lit(mail).alias("column"), "original", F.concat(name, digits(hmac_hex(F.col("original"), key), 4), F.lit("@example.org")).alias("token"))
    return apart(made, key)


def collisions(mapping: DataFrame) -> DataFrame:
    """Tokens that stand for several originals, which a reversal can't tell apart."""
    return mapping.groupBy("column", "token").agg(F.count(F.lit(1)).alias("originals")).where("originals > 1")


def restore(df: DataFrame, mapping: DataFrame, cols: list[str]) -> DataFrame:
    """The originals of tokens; a mapping in which originals share a token is refused, as it can't be reversed."""
    if not collisions(mapping).isEmpty():
        raise ValueError("several originals share a token; see collisions()")
    return apply_mapping(df, mapping, cols, "token", "original")
