"""Tables that change together: new files beside the old ones, and a manifest that names what counts.

A table is dealt by a hash of its parent key into buckets, each a folder of Parquet. A commit rewrites the buckets in which parents are
replaced, of all tables that it changes, into folders of its own, and then writes one manifest with the places of all buckets. Readers take
the newest manifest. So all of a commit appears or nothing: if a task, the driver or a later table fails, the old manifest stands, and
its files have not been touched. What a change costs grows with the buckets that it touches, not with the table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Snapshots:
    """The tables in a folder of any store that Spark reaches. One writer at a time: a manifest's number is taken only once."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and nothing before the first commit."""
        place = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(place):
            return 0, {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(place) if s.getPath().getName().endswith(".json"))
        if not names:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{names[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1].split(".")[0]), json.loads(text)

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A table as the newest manifest has it, or some of its buckets."""
        told = self.manifest()[1][name]
        schema = StructType.fromJson(told["schema"])
        places = [p for b, p in sorted(told["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commit(self, changes: dict[str, tuple[str, DataFrame, DataFrame | None]]) -> int:
        """Replace the rows of parents in tables, all at once: {table: (parent key, new rows, parents to replace)}.

        All parents of the new rows are replaced, and those of the third part, of whom nothing may be left. Returns the manifest's number.
        """
        number, told = self.manifest()
        number, told = number + 1, dict(told)
        for name, (key, rows, parents) in changes.items():
            gone = rows.select(key) if parents is None else rows.select(key).unionByName(parents.select(key))
            gone = gone.distinct()
            hit = [r[0] for r in gone.select(self._bucket(key).alias("b")).distinct().collect()]  # BUCKETS numbers at most
            if name in told:
                known = self.read(name, hit)
                kept = known.join(gone, known[key].eqNullSafe(gone[key]), "left_anti")
                rows = kept.unionByName(rows.select(*known.columns))
            schema = told[name]["schema"] if name in told else json.loads(rows.schema.json())
            place = f"{self.folder}/v{number}/{name}"
            rows.withColumn("__bucket", self._bucket(key)).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(place)
            held = dict(told[name]["buckets"]) if name in told else {}
            for b in hit:
                held.pop(str(b), None)
                if self._fs.exists(self._path(f"{place}/__bucket={b}")):
                    held[str(b)] = f"{place}/__bucket={b}"
            told[name] = {"schema": schema, "buckets": held}
        self._write(number, json.dumps(told))
        return number

    def _write(self, number: int, text: str) -> None:
        """The manifest appears whole, under a number that nobody has."""
        draft, place = self._path(f"{self.folder}/drafts/{number:012d}.json"), self._path(f"{self.folder}/manifests/{number:012d}.json")
        if self._fs.exists(place):
            raise RuntimeError(f"manifest {number} has been written by another")
        self._fs.mkdirs(place.getParent())
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, place):
            raise RuntimeError(f"manifest {number} could not be put in place")
