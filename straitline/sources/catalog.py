"""Snapshots (vintages), the partitioned lake, and SQL views over processed tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "%Y%m%dT%H%M%SZ"
_VINTAGE = re.compile(r"retrieved_at=(\d{8}T\d{6}Z)$")


def encode(when: dt.datetime) -> str:
    """UTC second stamp; a time without a zone is taken as UTC. Stamps sort as times."""
    when = when.replace(tzinfo=dt.timezone.utc) if when.tzinfo is None else when.astimezone(dt.timezone.utc)
    return when.strftime(STAMP)


def decode(stamp: str) -> dt.datetime:
    return dt.datetime.strptime(stamp, STAMP).replace(tzinfo=dt.timezone.utc)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if it is missing."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


class Catalog:
    """Datasets below a root folder: ``raw/<name>/retrieved_at=...``, ``raw/<name>/date=.../hour=...``, ``processed/<name>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write_vintage(self, df: DataFrame, name: str, when: dt.datetime | None = None) -> str:
        """An immutable snapshot: a stamp that exists already is an error. The time is a column under another name than
        the partition's, which would hide it."""
        when = when or dt.datetime.now(dt.timezone.utc)
        stamp = encode(when)
        if "retrieved_at_ts" not in df.columns:
            df = df.withColumn("retrieved_at_ts", F.lit(decode(stamp)))
        df.write.mode("errorifexists").parquet(f"{self.root}/raw/{name}/retrieved_at={stamp}")
        return stamp

    def vintages(self, name: str) -> list[str]:
        return [m[1] for c in children(self.spark, f"{self.root}/raw/{name}") if (m := _VINTAGE.match(c)) and any(x.endswith(".parquet") for x in children(self.spark, f"{self.root}/raw/{name}/{c}"))]

    def resolve(self, name: str, as_of: dt.date | dt.datetime | None = None) -> str:
        """The newest stamp at or before ``as_of``; a bare date means to its end. Never a later one."""
        stamps = self.vintages(name)
        if as_of is not None:
            if not isinstance(as_of, dt.datetime):
                as_of = dt.datetime.combine(as_of, dt.time.max)
            stamps = [s for s in stamps if s <= encode(as_of)]
        if not stamps:
            raise FileNotFoundError(f"no vintage of {name} at or before {as_of}")
        return stamps[-1]

    def read_vintage(self, name: str, as_of: dt.date | dt.datetime | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/raw/{name}/retrieved_at={self.resolve(name, as_of)}")

    def append(self, df: DataFrame, name: str, ts: str = "ts", batch: str | None = None) -> None:
        """Rows into date, hour and batch partitions; with ``batch``, a column, rows of the same batch are replaced."""
        parts = df.withColumns({"date": F.to_date(ts), "hour": F.hour(ts), "batch": F.col(batch) if batch else F.lit("0")})
        out = parts.drop(*([batch] if batch else [])).write.partitionBy("date", "hour", "batch")
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if batch else out.mode("append")
        out.parquet(f"{self.root}/raw/{name}")

    def read_partitions(self, name: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The lake of hive folders, pruned to [start, end] by folder name."""
        df = self.spark.read.parquet(f"{self.root}/raw/{name}").drop("batch")
        df = df.where(F.col("date") >= F.lit(start)) if start else df
        return df.where(F.col("date") <= F.lit(end)) if end else df

    def read_legacy(self, name: str, schema: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Folders ``YYYY-MM-DD/HH`` without keys: the days that are wanted are listed and read; odd names are passed over."""
        base, days = f"{self.root}/raw/{name}", []
        for day in children(self.spark, base):
            try:
                d = dt.date.fromisoformat(day)
            except ValueError:
                continue
            if (start is None or d >= start) and (end is None or d <= end):
                days.append(f"{base}/{day}")
        if not days:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*days)

    def write_processed(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/processed/{name}")

    def read_processed(self, name: str) -> DataFrame:
        if not children(self.spark, f"{self.root}/processed/{name}"):
            raise FileNotFoundError(f"{name} isn't processed yet")
        return self.spark.read.parquet(f"{self.root}/processed/{name}")

    def register_views(self) -> list[str]:
        """A temporary view for each processed table: the SQL surface."""
        names = children(self.spark, f"{self.root}/processed")
        for n in names:
            self.read_processed(n).createOrReplaceTempView(n)
        return names
