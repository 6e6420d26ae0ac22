"""Tables kept in buckets of files under versions, and ids that last.

A table is a folder of Parquet files by bucket of the key's hash, and a log of versions. Each
version names one folder for every bucket, so that a change writes only the buckets that it
touches and all else stays as it is. A version is committed by putting its file under the next
number, which fails if another writer was faster; readers take the last version whole.

The log needs a file system where a rename onto an existing file fails, such as HDFS.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BUCKET = "_bucket"


class ConflictError(Exception):
    """Another writer committed first; nothing of this change is seen."""


class Files:
    """The few calls on the file system of a folder that Spark's readers and writers don't offer."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.at = self.hadoop.Path(path)
        self.fs = self.at.getFileSystem(self.conf)
        self.no_options = spark._sc._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at)] if self.fs.exists(self.at) else []

    def put_new(self, name: str, content: bytes) -> bool:
        """Write a file that isn't there yet, whole or not at all; whether it was done."""
        draft, final = self.hadoop.Path(self.at, f"draft-{uuid.uuid4().hex}"), self.hadoop.Path(self.at, name)
        out = self.fs.create(draft)
        out.write(content)
        out.close()
        try:
            self.hadoop.FileContext.getFileContext(self.at.toUri(), self.conf).rename(draft, final, self.no_options)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def delete(self) -> None:
        self.fs.delete(self.at, True)


@dataclass(frozen=True)
class Log:
    """Numbered JSON entries; each number can be taken once."""

    spark: SparkSession
    path: str

    def entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{number:012d}", wholetext=True).first()[0]) if number >= 0 else {}

    def last(self) -> tuple[int, dict]:
        """(number, entry) of the last commit; (-1, {}) without any."""
        number = max((int(name) for name in Files(self.spark, self.path).names() if name.isdigit()), default=-1)
        return number, self.entry(number)

    def commit(self, number: int, entry: dict) -> None:
        if not Files(self.spark, self.path).put_new(f"{number:012d}", json.dumps(entry).encode()):
            raise ConflictError(f"{self.path}: {number} is taken")


@dataclass(frozen=True)
class VersionedTable:
    """Rows with a key, in ``buckets`` parts by its hash. Rows of one key share a bucket."""

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/versions")

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders.values())

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one if none is given; they stay as they are while others write."""
        return self._read(self.folders(version))

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Bucket -> folder of a version, the last one if none is given."""
        entry = self.log.last()[1] if version is None else self.log.entry(version)
        return entry.get("folders", {})

    def upsert(self, updates: DataFrame, base: int | None = None) -> int:
        """The version with the rows of ``updates`` in place of those of the same key, and new keys added.

        Only buckets of updated keys are read and written. ``base`` is the version that the
        updates were made from; if it isn't the last one any more, the commit fails.
        """
        return self._change(updates.select(self.schema.names), updates.select(self.key), base)

    def refresh(self, new: DataFrame, value: str, base: int | None = None) -> int:
        """As `upsert` for child rows under their parent's key: a parent with new, non-blank children loses its old ones."""
        fresh = new.withColumn(value, F.trim(value)).where(F.col(value) != "")
        return self._change(fresh.select(self.schema.names), fresh.select(self.key), base)

    def _change(self, rows: DataFrame, keys: DataFrame, base: int | None) -> int:
        base = self.log.last()[0] if base is None else base
        folders = self.folders(base)
        touched = {str(r[0]) for r in keys.select(self.bucket()).distinct().collect()}  # at most ``buckets`` numbers
        old = self._read({b: at for b, at in folders.items() if b in touched})
        changed = old.join(keys.distinct(), self.key, "left_anti").select(self.schema.names).unionByName(rows)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        changed.withColumn(BUCKET, self.bucket()).repartition(BUCKET, self.key).write.partitionBy(BUCKET).parquet(folder)
        prefix = f"{BUCKET}="
        written = {name.removeprefix(prefix): f"{folder}/{name}" for name in Files(self.spark, folder).names() if name.startswith(prefix)}
        try:
            self.log.commit(base + 1, {"folders": {b: at for b, at in folders.items() if b not in touched} | written})
        except ConflictError:
            Files(self.spark, folder).delete()  # its own files, which no version names
            raise
        return base + 1


def append_with_ids(rows: DataFrame, path: str, name: str = "row_id") -> tuple[int, int]:
    """Append ``rows`` with an id each, written with the row, so that it is the same at every read.

    A range is taken from the log of ids before anything is written; a write that fails leaves a
    gap, and no id is given twice. Each partition numbers its own part of the range. Returns the
    range's first and last id.
    """
    spark = rows.sparkSession
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)).write.parquet(draft)
    kept = spark.read.schema(StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())])).parquet(draft)
    counts = [(r[0], r[1]) for r in kept.groupBy("_part").count().collect()]  # one small row for each task of the write
    total = sum(n for _, n in counts)
    log = Log(spark, f"{path}/ids")
    while True:
        number, entry = log.last()
        first = entry.get("next", 0)
        try:
            log.commit(number + 1, {"next": first + total})
            break
        except ConflictError:
            continue  # another writer took that range; take the next
    bases, at = [], first
    for part, n in sorted(counts):
        bases.append((part, at))
        at += n
    start = spark.createDataFrame(bases, "_part int, _base long")
    kept.join(F.broadcast(start), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base").write.mode("append").parquet(f"{path}/rows")
    Files(spark, draft).delete()
    return first, at - 1


def read_with_ids(spark: SparkSession, path: str, schema: StructType, name: str = "row_id") -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(name, LongType())])).parquet(f"{path}/rows")
