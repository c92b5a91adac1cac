"""Keyed tables: rows replaced by key, all of a write at once or none of it.

A table is a folder of buckets of rows and a list of commits.  A commit names
for each bucket the folder that holds it now.  A write gives new folders to the
buckets of its keys and then makes the next commit; what is written before is
seen by nobody, so a write that breaks off leaves the table as it was, and one
that is repeated leaves each key once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table.
BUCKETS = 32
#: Writes of others that one write lets pass before it gives up.
ATTEMPTS = 10
_BUCKET = "keyed_bucket"


class Conflict(RuntimeError):
    """Another write made the commit first."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema)

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str:
        where, system = self._files(path)
        stream = system.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commits(self) -> list[int]:
        """The numbers of all commits, also of one that its writer did not finish."""
        where, system = self._files(f"{self.path}/commits")
        if not system.exists(where):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in system.listStatus(where) if s.getPath().getName().endswith(".json"))

    def current(self) -> tuple[int, dict]:
        """The number of the newest commit, and the newest one that is whole."""
        numbers = self.commits()
        for n in reversed(numbers):
            try:
                doc = json.loads(self._read_text(f"{self.path}/commits/{n:012d}.json"))
            except ValueError:  # its writer broke off: it never came about
                continue
            return numbers[-1], doc
        return (numbers[-1] if numbers else 0), {"buckets": self.buckets, "at": {}}

    def _commit(self, number: int, doc: dict) -> None:
        where, system = self._files(f"{self.path}/commits/{number:012d}.json")
        try:
            out = system.create(where, False)
        except Exception as error:
            raise Conflict(f"commit {number} is there already") from error
        try:
            out.write(bytearray(json.dumps(doc, sort_keys=True).encode()))
        finally:
            out.close()

    def _of(self, doc: dict, buckets: list[int] | None = None) -> DataFrame:
        at = {k: v for k, v in doc["at"].items() if buckets is None or int(k) in buckets}
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{folder}" for folder in sorted(at.values())))

    def read(self) -> DataFrame:
        return self._of(self.current()[1])

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(n)).cast("int")

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """New rows replace those with their keys; returns the commit.  Of new rows with the same key the last by ``order`` stays, else any one.

        ``rows`` are computed once.  Where another write comes between, this one
        begins again from what that left.
        """
        from siftwell.operators.graph import settle

        picked = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc(order) if order else F.lit(0)))
        new = settle(picked.withColumn("__last", last).where("__last = 1").drop("__last"))
        for _ in range(ATTEMPTS):
            number, doc = self.current()
            n = doc["buckets"]
            touched = sorted(r[0] for r in new.select(self._bucket(n).alias("b")).distinct().collect())  # buckets at most
            if not touched:
                return number
            named = new.select(*(F.col(k).alias(f"__{k}") for k in self.keys))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
            old = self._of(doc, touched).join(named, same, "left_anti").select(*self.schema.names)
            folder = f"data/{uuid.uuid4().hex}"
            merged = old.unionByName(new).withColumn(_BUCKET, self._bucket(n))
            merged.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
            try:
                self._commit(number + 1, {"buckets": n, "at": doc["at"] | {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}})
                return number + 1
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other writes came first")

    def sweep(self) -> int:
        """Removes the folders of earlier commits and of writes that broke off; returns how many.  Not while others read or write."""
        where, system = self._files(f"{self.path}/data")
        if not system.exists(where):
            return 0
        used = {folder.split("/")[1] for folder in self.current()[1]["at"].values()}
        gone = [s.getPath() for s in system.listStatus(where) if s.getPath().getName() not in used]
        for path in gone:
            system.delete(path, True)
        return len(gone)
