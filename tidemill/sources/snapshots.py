"""Tables of versioned snapshots: new partitions are written beside the old ones, and a version is one small file.

``root/data/<write>/_part=<name>`` holds a partition's files and ``root/versions/<number>`` the list of partitions of a version, one line each.  A
commit writes its partitions, then its list under a name of its own, and at last renames the list to the next number, which the
file system does at once and refuses if the number is taken.  Until then readers see the version before, and
after a crash between any two steps as well; of two writers that started from one version the second is refused.  Partitions whose
rows have not changed keep their files.  The driver handles lines of partitions, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: The column of a row's partition, and the same in the folders' names.
PART, FOLDER = "part", "_part"
#: Rows that a task compares or writes, about.
TASK_ROWS = 500_000


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit was made for."""


class Snapshots:
    """A table of snapshots under ``root``; ``schema`` is that of its rows with their ``part``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        at = self._path("versions")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def parts(self, version: int | None = None) -> dict[str, dict]:
        """The partitions of a version (the last by default): folder, rows and digest of each."""
        found = self.versions()
        if version is None and not found:
            return {}
        lines = self.spark.read.text(f"{self.root}/versions/{found[-1] if version is None else version}").collect()
        return {e["part"]: e for e in (json.loads(r.value) for r in lines if r.value)}

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of a version, of all its partitions or of some."""
        entries = self.parts(version)
        folders = [f"{self.root}/{e['folder']}" for name, e in entries.items() if parts is None or name in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, drop: list[str] = (), base: int | None = None, step=lambda name: None) -> int | None:
        """Replace the partitions of ``rows`` and remove ``drop``; the new version, or None if nothing would change.

        ``base`` is the version that the rows were made from (the last by default): if another has been committed since, :class:`Conflict` is
        raised.  ``step`` is called with the name of each step before it begins.
        """
        found = self.versions()
        base = (found[-1] if found else 0) if base is None else base
        before = self.parts(base) if base else {}
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(columns)
        # equal rows count, so the digest is a sum and not a difference; order does not matter
        line = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
        digests = {r[PART]: r for r in rows.groupBy(PART).agg(F.count("*").alias("rows"), F.sum(line).cast("string").alias("digest")).collect()}
        same = [p for p, d in digests.items() if p in before and (before[p]["rows"], before[p]["digest"]) == (d["rows"], d["digest"])]
        new = {p: d for p, d in digests.items() if p not in same}
        gone = [p for p in drop if p in before and p not in digests]
        if not new and not gone:
            return None
        write = f"data/{uuid.uuid4().hex}"
        step("write")
        if new:
            # a partition of more than TASK_ROWS is written by several tasks, as files of its own
            cuts = {p: -(-d["rows"] // TASK_ROWS) for p, d in new.items()}
            cut = F.lit(1)
            for n in set(cuts.values()) - {1}:
                cut = F.when(F.col(PART).isin([p for p, c in cuts.items() if c == n]), n).otherwise(cut)
            tasks = max(sum(cuts.values()), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows.where(F.col(PART).isin(list(new))).withColumn(FOLDER, F.col(PART)).repartition(tasks, FOLDER, F.pmod(F.xxhash64(*columns), cut)).write.partitionBy(FOLDER).parquet(f"{self.root}/{write}")
        folders = {}
        if new:
            for status in self.fs.listStatus(self._path(write)):
                name = status.getPath().getName()
                if name.startswith(FOLDER + "="):
                    folders[self.jvm.java.net.URLDecoder.decode(name[len(FOLDER) + 1 :].replace("+", "%2B"), "UTF-8")] = f"{write}/{name}"
        entries = {p: e for p, e in before.items() if p not in new and p not in gone} | {p: {"part": p, "folder": folders[p], "rows": d["rows"], "digest": d["digest"]} for p, d in new.items()}
        step("list")
        self.fs.mkdirs(self._path("versions"))
        draft = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(e, sort_keys=True) + "\n" for e in sorted(entries.values(), key=lambda e: e["part"])), "utf-8"))
        out.close()
        step("commit")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"versions/{base + 1}"), none)
        except Exception as taken:
            self.fs.delete(draft, False)
            raise Conflict(f"version {base + 1} of {self.root} is taken") from taken
        return base + 1

    def vacuum(self, keep: int) -> int:
        """Delete all but the last ``keep`` versions and the folders that none of these names, also those of commits that never came to an end; how many folders.

        No writer may be at work.
        """
        found = self.versions()
        named = {e["folder"] for v in found[-keep:] for e in self.parts(v).values()}
        for v in found[:-keep]:
            self.fs.delete(self._path(f"versions/{v}"), False)
        n = 0
        for write in self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else []:
            parts = [p.getPath() for p in self.fs.listStatus(write.getPath())]
            useful = [p for p in parts if f"data/{write.getPath().getName()}/{p.getName()}" in named]
            for p in parts if useful else [write.getPath()]:
                if p not in useful:
                    n += p.getName().startswith(FOLDER)
                    self.fs.delete(p, True)
        return n


def compact(table: Snapshots, key: str, day: str, coarse: str, today: Column, keep_days: int, step=lambda name: None) -> tuple[int | None, DataFrame]:
    """(version, conflicts): merge the partitions of each period that is due into one, all in one commit.

    ``coarse`` is the period as a date format (``yyyy-MM`` for months); due are periods whose last day is more than ``keep_days`` before ``today``.  Rows that are equal in all
    columns but ``part`` are merged into one.  A period in which a ``key`` has two contents is refused: its partitions stay, and ``conflicts`` counts its keys.  Rows without a day belong to
    no period and stay.
    """
    versions = table.versions()
    rows = table.read()
    period = F.date_format(day, coarse)
    ends = {"yyyy-MM": F.last_day(F.min(day)), "yyyy": F.last_day(F.add_months(F.date_trunc("year", F.min(day)).cast("date"), 11))}[coarse]
    due = rows.withColumn("_p", period).where("_p IS NOT NULL").groupBy("_p").agg((F.date_add(ends, keep_days) < today).alias("due")).where("due").select("_p")
    # rows are mostly unique, so they are dealt as they are; a task gets TASK_ROWS of them, however many there are
    tasks = max(-(-rows.count() // TASK_ROWS), int(table.spark.conf.get("spark.sql.shuffle.partitions")))
    plain = rows.drop(PART).withColumn("_p", period).join(due, "_p", "left_semi").repartition(tasks, key).distinct()
    conflicts = plain.groupBy("_p", key).agg(F.count("*").alias("n")).where("n > 1").groupBy(F.col("_p").alias("period")).agg(F.count("*").alias("keys"))
    conflicts = materialise(conflicts, "conflicts")
    merged = materialise(plain.join(conflicts.select(F.col("period").alias("_p")), "_p", "left_anti").withColumn(PART, F.col("_p")), "merged")
    # partitions that hold rows of merged periods only are replaced by them
    of_part = rows.select(PART, period.alias("_p")).distinct().join(merged.select("_p").distinct().withColumn("_m", F.lit(True)), "_p", "left")
    drop = [r[PART] for r in of_part.groupBy(PART).agg(F.bool_and(F.coalesce("_m", F.lit(False))).alias("all")).where("all").select(PART).collect()]
    some = of_part.groupBy(PART).agg(F.bool_and(F.coalesce("_m", F.lit(False))).alias("all"), F.bool_or(F.coalesce("_m", F.lit(False))).alias("some")).where("some AND NOT all").select(PART)
    if not some.isEmpty():
        raise ValueError("a partition holds rows of a merged period beside others: " + some.first()[PART])
    return table.commit(merged.drop("_p"), drop, versions[-1] if versions else None, step), conflicts
