"""Readers and writers of files: delimited text, JSON, XML, pages of an API, notebooks, vectors, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import looks_like_sql, sql_magic
from sparkloom.operators.sequence import with_row_number
from sparkloom.shared import fresh_path, shared_folder  # noqa: F401  (the queries take them from here)
from sparkloom.sources.delimited import encodings, read_csv  # noqa: F401


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs to columns named by their path."""
    def walk(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, (*path, f.name))
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(sep.join((*path, f.name)))

    return df.select(*walk(df.schema, ()))


def read_any(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """CSV, JSON or XML by the ending of the path."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "json":
        return flatten(spark.read.json(path, multiLine=True))
    if ending == "xml":
        return flatten(spark.read.format("xml").option("rowTag", row_tag or "row").load(path), "_")
    return read_csv(spark, path)


def write_any(df: DataFrame, path: str, row_tag: str = "row") -> None:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "json":
        df.write.json(path)
    elif ending == "xml":
        df.write.format("xml").option("rowTag", row_tag).save(path)
    else:
        df.write.csv(path, header=True, escape='"')


def append_with_rejects(df: DataFrame, ok, path: str, rejects: str) -> None:
    """Good rows to one table, the others to another."""
    df.where(ok).write.mode("append").parquet(path)
    df.where(~F.coalesce(ok, F.lit(False))).write.mode("append").parquet(rejects)


def api_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``value`` with ``signInActivity`` lifted, and a row a page with its context, count and next link."""
    rows = raw.select(F.explode("value").alias("v")).select("v.*")
    if "signInActivity" in rows.columns:
        rows = rows.select(*[c for c in rows.columns if c != "signInActivity"], "signInActivity.*")
    tags = [c for c in raw.columns if c.startswith("@odata.")]
    return rows, raw.select(*[F.col(f"`{c}`").alias(c[1:].replace(".", "_")) for c in tags])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """tokens of each line, cut at spaces and tabs, carriage returns dropped."""
    return spark.read.text(path).select(F.array_remove(F.split(F.translate("value", "\r", ""), "[ \t]+"), "").alias("tokens"))


def save_vectors(df: DataFrame, path: str, text: bool = False) -> None:
    """word, vec; as Parquet, or as text with a line a word."""
    if text:
        df.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))).write.text(path)
    else:
        df.write.parquet(path)


def load_vectors(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    if not text:
        return spark.read.parquet(path)
    parts = F.split(F.trim("value"), " ")
    head = F.size("p").eqNullSafe(2) & F.col("p")[0].rlike(r"^\d+$") & F.col("p")[1].rlike(r"^\d+$")  # two whole numbers
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") > 1) & ~head)
    return rows.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def save_vocab(df: DataFrame, path: str) -> None:
    df.select("word", "cn").write.csv(path, sep=" ")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, cn long").csv(path, sep=" ")


def export_chunks(df: DataFrame, path: str, rows: int, order_by: list[str]) -> None:
    """Exactly ``rows`` rows a chunk, in order, in folders ``chunk=0``, ``chunk=1`` and so on."""
    chunked = with_row_number(df, order_by).withColumn("chunk", F.floor((F.col("_row") - 1) / rows).cast("int"))
    chunked.repartition("chunk").sortWithinPartitions("chunk", "_row").drop("_row").write.partitionBy("chunk").parquet(path)


def save_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.col("parent").alias("Parent"), F.col("child").alias("Child"), F.lit("").alias("Comment")).write.csv(path, sep="\t", header=True)


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("record_id"), F.concat(F.lit("record "), F.col("id").cast("string")).alias("name"))


NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:array<string>,outputs:array<struct<data:map<string,string>>>>>>"


def notebook_grids(raw: DataFrame) -> DataFrame:
    """path, source, recorded, actual, row (a map) from notebooks read as whole texts (columns path, value): results
    of ``SELECT * FROM source`` cells. ``recorded`` is the count that the first output tells, ``actual`` that of the rows
    in the table output; a table without rows gives one row with null."""
    cells = raw.select("path", F.explode(F.from_json("value", NOTEBOOK)["cells"]).alias("c")).where("c.cell_type = 'code'")
    grid = F.filter(F.transform("c.outputs", lambda o: o["data"]["application/vnd.dataresource+json"]), lambda d: d.isNotNull())
    found = cells.select(
        "path", F.trim(F.regexp_replace(F.array_join("c.source", ""), r"(?i)^\s*select \* from ", "")).alias("source"),
        F.regexp_extract(F.try_element_at("c.outputs", F.lit(1))["data"]["text/html"], r"(\d+)", 1).try_cast("long").alias("recorded"),
        F.from_json(F.try_element_at(grid, F.lit(1)), "struct<data:array<map<string,string>>>")["data"].alias("rows"),
    ).where("rows is not null")
    return found.select("path", "source", "recorded", F.size("rows").alias("actual"), F.explode_outer("rows").alias("row"))


def first_named(value: Column, paths: list[str]) -> Column:
    """The first of the paths into a JSON text that has more than blanks, in small letters."""
    found = F.filter(F.array(*[F.trim(F.lower(F.get_json_object(value, p))) for p in paths]), lambda x: x != "")  # each made once
    return F.when(value != "{}", F.get(found, F.lit(0)))


# Where notebooks and cells tell their language, first to last, and languages that are SQL.
NOTEBOOK_LANGUAGE = [f"$.{at}language_info.name" for at in ("custom.metadata.", "metadata.", "")] + [
    f"$.{at}kernelspec.{name}" for at in ("custom.metadata.", "metadata.", "") for name in ("language", "name", "display_name")
]
CELL_LANGUAGE = [
    "$.language", "$.vscode.languageId", "$.dotnet_interactive.language", "$.polyglot_notebook.kernelName", "$.custom.metadata.language", "$.custom.metadata.vscode.languageId",
]
SQL_LANGUAGES = (
    "sql", "tsql", "t-sql", "mssql", "mysql", "postgresql", "postgres", "sqlite", "plsql", "snowflake", "bigquery", "redshift", "duckdb", "trino", "presto", "oracle", "db2", "sparksql",
)
SQL_PREFIX = "^(sql-|sql_|mssql-)"


def is_sql_language(language: Column) -> Column:
    return F.coalesce(language.isin(*SQL_LANGUAGES) | language.rlike(SQL_PREFIX), F.lit(False))


def notebook_cells(raw: DataFrame) -> DataFrame:
    """path, cell, cell_type, notebook_language, language, is_sql, source from notebooks as whole texts (columns path, value).

    A cell without a language has its notebook's. A code cell is SQL if its own language is, or, unless its own is another, if the
    notebook's is or its text looks like it; or by a magic in its first line."""
    kind = "struct<metadata:string,cells:array<struct<cell_type:string,metadata:string,source:string>>>"
    books = raw.select("path", F.from_json("value", kind).alias("book"))  # the text is parsed once, the languages are in its head
    cells = books.select("path", first_named(F.col("book.metadata"), NOTEBOOK_LANGUAGE).alias("notebook_language"), F.posexplode("book.cells").alias("cell", "c"))
    source = F.coalesce(F.array_join(F.from_json("c.source", "array<string>"), ""), F.col("c.source"), F.lit(""))
    cells = cells.select("path", "cell", F.lower(F.trim("c.cell_type")).alias("cell_type"), "notebook_language", first_named(F.col("c.metadata"), CELL_LANGUAGE).alias("own"), source.alias("source"))
    own_sql = is_sql_language(F.col("own"))
    other = F.col("own").isNotNull() & ~own_sql
    sql = own_sql | sql_magic(F.col("source")) | (~other & (is_sql_language(F.col("notebook_language")) | looks_like_sql(F.col("source"))))
    return cells.select("path", "cell", "cell_type", "notebook_language", F.coalesce("own", "notebook_language").alias("language"), ((F.col("cell_type") == "code") & sql).alias("is_sql"), "source")
