"""Tables in versions: loads write beside what is read, and a log file that appears in one step makes them current.

A table is a folder with ``data``, where each load writes a folder of its own, and ``log``, one JSON file a version with the
schema and the parts: folders of ``data``, each with the conditions of the rows that later loads took away. A reader takes the
newest version once and keeps to it; no load changes or removes a folder that a version names. A writer that is lost leaves a
folder that no version names, which ``sweep`` removes later. Of two writers that build on one version, the second gets an
error, as its log file is there already.

The log needs a file system with a rename that is atomic and does not overwrite (HDFS, local disks)."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.diff import fingerprints_match

#: Conditions on a part after which a load puts the table together anew.
CONDITIONS = 20
GROUP = "_group"


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


@dataclass
class Version:
    number: int
    schema: T.StructType
    by: str | None = None
    #: folder (below the table's), key of its group, conditions of rows that don't count
    parts: list[dict] = field(default_factory=list)


def group_key(by: str) -> Column:
    """A name for a folder from any value; null has one of its own."""
    return F.coalesce(F.md5(F.concat(F.lit("v"), F.col(by).cast("string"))), F.lit("null"))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    # -- versions ----------------------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at("log")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or that of a number; None if there is none."""
        numbers = self.numbers()
        if number is None and not numbers:
            return None
        number = numbers[-1] if number is None else number
        text = self.spark.read.text(f"{self.path}/log/{number:020d}.json", wholetext=True).first().value
        found = json.loads(text)
        return Version(number, T.StructType.fromJson(found["schema"]), found["by"], found["parts"])

    def commit(self, version: Version) -> Version:
        """Make a version current, all at once. Its number must be free."""
        content = json.dumps({"schema": version.schema.jsonValue(), "by": version.by, "parts": version.parts})
        self._fs.mkdirs(self._at("log"))
        draft = self._at("log", f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(self._at("log", f"{version.number:020d}.json")), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if version.number in self.numbers():
                raise Conflict(f"version {version.number} of {self.path} is there already") from e
            raise
        return version

    # -- reading -----------------------------------------------------------------------------------------------

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that ``sweep`` has kept. Loads that follow don't change what it gives."""
        version = self.version(number)
        if version is None:
            raise AnalysisException(f"{self.path} has no version")
        return self._rows(version)

    def _rows(self, version: Version) -> DataFrame:
        alike: dict[tuple[str, ...], list[str]] = {}
        for p in version.parts:
            alike.setdefault(tuple(p["without"]), []).append(f"{self.path}/data/{p['folder']}")
        out = None
        for without, folders in alike.items():
            rows = self.spark.read.schema(version.schema).parquet(*folders)
            for condition in without:
                rows = rows.where(~F.coalesce(F.expr(condition), F.lit(False)))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], version.schema) if out is None else out

    # -- loading -----------------------------------------------------------------------------------------------

    def ensure(self, schema: T.StructType, by: str | None = None) -> Version:
        """The newest version; an empty first one where there is none. ``by`` keeps a folder a value of this column."""
        found = self.version()
        if found:
            return found
        try:
            return self.commit(Version(0, schema, by))
        except Conflict:
            return self.version()

    def stage(self, source: DataFrame, version: Version) -> list[dict]:
        """Write rows beside the table; the parts they make. Nothing reads them before a commit."""
        folder = uuid.uuid4().hex
        rows = source.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in version.schema])
        if version.by is None:
            rows.write.parquet(f"{self.path}/data/{folder}")
            return [{"folder": folder, "group": None, "without": []}]
        rows = rows.withColumn(GROUP, group_key(version.by))
        rows.write.partitionBy(GROUP).parquet(f"{self.path}/data/{folder}")
        groups = [s.getPath().getName() for s in self._fs.listStatus(self._at("data", folder)) if s.isDirectory()]
        return [{"folder": f"{folder}/{g}", "group": g.split("=", 1)[1], "without": []} for g in sorted(groups)]

    def _staged(self, parts: list[dict], version: Version) -> DataFrame:
        return self._rows(Version(-1, version.schema, version.by, parts))

    def load(self, source: DataFrame, condition: str | None = None, by: str | None = None, verify: bool = True) -> dict:
        """Replace all rows, or those of a condition, by the rows of the source (of the condition). Where both sides agree already,
        nothing is written. Staged rows are held against the source before they become current.

        version, changed, num_rows (of the source's side)."""
        now = self.ensure(source.schema, by)
        wanted = source if condition is None else source.where(condition)
        held = self._rows(now) if condition is None else self._rows(now).where(condition)
        compared = fingerprints_match(wanted.select(*held.columns), held).first()
        stats = {"version": now.number, "changed": not compared.is_matching, "num_rows": compared.a_num_rows}
        if compared.is_matching:
            return stats
        parts = self.stage(wanted, now)
        if verify and not fingerprints_match(wanted.select(*held.columns), self._staged(parts, now)).first().is_matching:
            raise RuntimeError(f"staged rows of {self.path} don't agree with the source; the table stays at version {now.number}")
        kept = [] if condition is None else [p | {"without": [*p["without"], condition]} for p in now.parts]
        if any(len(p["without"]) > CONDITIONS for p in kept):
            kept = self.stage(self._rows(Version(-1, now.schema, now.by, kept)), now)
        return stats | {"version": self.commit(Version(now.number + 1, now.schema, now.by, kept + parts)).number}

    def load_groups(self, source: DataFrame, by: str, verify: bool = True) -> dict:
        """Load only the groups whose fingerprints differ from the source's; the folders of the others stay as they are. Groups that the
        source has no longer go.

        version, changed (number of groups loaded or gone), num_rows (loaded)."""
        now = self.ensure(source.schema, by)
        if now.by != by:
            raise ValueError(f"{self.path} is kept by {now.by}, not by {by}")
        names = [f.name for f in now.schema]
        compared = fingerprints_match(source.select(*names), self._rows(now), by).where("not is_matching")
        # a row a group, as the log has
        stale = compared.select(group_key(by).alias("key"), F.coalesce("a_num_rows", F.lit(0)).alias("n")).collect()
        stats = {"version": now.number, "changed": len(stale), "num_rows": sum(r.n for r in stale)}
        if not stale:
            return stats
        keys = self.spark.createDataFrame([(r.key,) for r in stale], f"{GROUP} string")
        rows = source.withColumn(GROUP, group_key(by)).join(F.broadcast(keys), GROUP, "left_semi").drop(GROUP)
        parts = self.stage(rows, now) if stats["num_rows"] else []
        if verify and parts and not fingerprints_match(rows.select(*names), self._staged(parts, now)).first().is_matching:
            raise RuntimeError(f"staged groups of {self.path} don't agree with the source; the table stays at version {now.number}")
        gone = {r.key for r in stale}
        kept = [p for p in now.parts if p["group"] not in gone]
        return stats | {"version": self.commit(Version(now.number + 1, now.schema, by, kept + parts)).number}

    # -- keeping in order --------------------------------------------------------------------------------------

    def sweep(self, keep: int = 10, older_than_s: float = 7 * 86_400) -> list[str]:
        """Remove logs but the newest ``keep``, and folders of data that no kept version names and that are older than given, so
        that neither a running writer's nor a reader's folder goes. The names of the folders that went."""
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._at("log", f"{number:020d}.json"), False)
        named = {p["folder"].split("/")[0] for n in self.numbers() for p in self.version(n).parts}
        gone = []
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                name = s.getPath().getName()
                if name not in named and s.getModificationTime() / 1000 <= time.time() - older_than_s:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone
