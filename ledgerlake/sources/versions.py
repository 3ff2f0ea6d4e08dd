"""Tables whose changes are all or nothing: data that never changes once written, and numbered manifests that name it.

A manifest lists the folder of each part of the table. Writing adds folders that nobody sees, counts what arrived, and then
adds the next manifest by a rename that fails if another writer took its number. So a reader sees one version or the next
one, a failed write leaves the table as it was, a part that didn't change isn't written again, and going back is a manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"


class Conflict(RuntimeError):
    """Another writer published first; the write has to be made again from what is there now."""


@dataclass(frozen=True)
class Manifest:
    number: int
    schema: dict
    folders: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    batch: int = -1

    @property
    def count(self) -> int:
        return sum(self.rows.values())


class VersionedTable:
    """A table under root, a folder that driver and executors share, on a file system whose rename is atomic.

    Its parts are few (months, buckets): a manifest lists each of them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The manifest of a number, or the last one; None if there is none."""
        known = self.numbers()
        if not known or number is not None and number not in known:
            return None
        at = f"{self.root}/manifests/{(known[-1] if number is None else number):010d}.json"
        return Manifest(**json.loads(self.spark.read.text(at, wholetext=True).first()[0]))

    def read(self, number: int | None = None, parts: set[str] | None = None) -> DataFrame:
        """The table, or some of its parts, as of a manifest. Later changes don't reach it."""
        m = self.manifest(number)
        if m is None:
            raise ValueError(f"{self.root} has no such version")
        schema = StructType.fromJson(m.schema)
        paths = [f"{self.root}/data/{folder}" for name, folder in m.folders.items() if parts is None or name.removeprefix(f"{PART}=") in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, df: DataFrame, part: Column | None = None, expected: int | None = None, batch: int = -1, replaces: set[str] | None = None) -> Manifest:
        """The table becomes df, dealt to parts by the text of part, or, with replaces, only the parts that are named there
        do, and those that df has. Rows have to arrive in the number that was written, and in the expected one, if any."""
        old = self.manifest()
        folder, seen = uuid.uuid4().hex, Observation()
        rows = df.withColumn(PART, F.lit("all") if part is None else F.coalesce(part.cast("string"), F.lit("none")))
        if part is not None:  # a part is a few files of a good size, and a large one isn't one task's
            rows = rows.hint("rebalance", PART)
        try:
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(PART).parquet(f"{self.root}/data/{folder}")
            names = [n for n in self._names(f"data/{folder}") if n.startswith(f"{PART}=")]
            there = self.spark.read.parquet(f"{self.root}/data/{folder}").groupBy(F.col(PART).cast("string").alias(PART)).count().collect() if names else []
            n, arrived = seen.get["n"], sum(r["count"] for r in there)
            if arrived != n or expected is not None and n != expected:
                raise ValueError(f"{n} rows were written, {arrived} arrived" + (f", {expected} were expected" if expected is not None else ""))
            counts = {f"{PART}={r[PART]}": r["count"] for r in there}
            folders, rows_of = {n: f"{folder}/{n}" for n in names}, {n: counts[n] for n in names}
            if replaces is not None and old is not None:
                gone = {f"{PART}={p}" for p in replaces} | set(names)
                folders |= {k: v for k, v in old.folders.items() if k not in gone}
                rows_of |= {k: v for k, v in old.rows.items() if k not in gone}
            return self._commit(Manifest((old.number if old else 0) + 1, df.schema.jsonValue(), folders, rows_of, batch))
        except BaseException:
            self._fs.delete(self._path(f"data/{folder}"), True)
            raise

    def _commit(self, m: Manifest) -> Manifest:
        """Writes the manifest under a name that nobody reads, then gives it its number, unless that is taken."""
        hidden = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(hidden, self._path(f"manifests/{m.number:010d}.json"), none)
        except Exception as e:
            self._fs.delete(hidden, False)
            if m.number in self.numbers():
                raise Conflict(f"version {m.number} is there already") from e
            raise
        return m

    def roll_back(self, number: int) -> Manifest:
        """The table becomes again what it was; the versions since stay readable."""
        m, last = self.manifest(number), self.manifest()
        if m is None:
            raise ValueError(f"no version {number}")
        return self._commit(Manifest(last.number + 1, m.schema, m.folders, m.rows, m.batch))

    def clear(self, keep: int) -> int:
        """Removes what only versions before the last ``keep`` have; returns how many folders went. Readers of these
        versions and writers have to be done."""
        known = self.numbers()
        kept = {f for n in known[-keep:] for f in self.manifest(n).folders.values()}
        gone = [f"{a}/{b}" for a in self._names("data") for b in self._names(f"data/{a}") if b.startswith(f"{PART}=") and f"{a}/{b}" not in kept]
        for n in known[:-keep]:
            self._fs.delete(self._path(f"manifests/{n:010d}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f"data/{f}"), True)
        return len(gone)
