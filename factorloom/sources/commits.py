"""A keyed Parquet table with a log of commits.

A commit is a numbered file that names the folders of all live buckets; it is put in place by one rename once its data
are there, so readers see the state before or after it and never a part, and a run that dies between leaves files that
no commit names. Buckets are the last bits of the keys' hash, more bits where a bucket has grown, so their number follows
the rows. One writer at a time; readers at any."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitTable:
    """Rows of a schema, of which the latest by ``arrival`` counts for each key.

    bucket_rows: a bucket that would have more is split as it is written."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], arrival: str, bucket_rows: int = 2_000_000):
        self.spark, self.path, self.schema, self.keys, self.arrival, self.bucket_rows = spark, path.rstrip("/"), schema, keys, arrival, bucket_rows
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The numbers of the commits that are there."""
        if not self._fs.exists(self._at("log")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit_of(self, version: int | None = None) -> dict:
        """version, tags and buckets (bits, value, folder, rows) of a commit, the last by default; before the first a table without rows."""
        there = self.versions()
        if version is None and not there:
            return {"version": 0, "tags": {}, "buckets": [{"bits": 0, "value": 0, "folder": None, "rows": 0}]}
        version = there[-1] if version is None else version
        if version not in there:
            raise ValueError(f"no commit {version}")
        return json.loads(self.spark.read.text(f"{self.path}/log/{version:010d}.json", wholetext=True).first()[0])

    def _rows_of(self, buckets: list[dict]) -> DataFrame:
        folders = [f"{self.path}/{b['folder']}" for b in buckets if b["folder"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a commit, the last by default."""
        return self._rows_of(self.commit_of(version)["buckets"])

    def _log(self, commit: dict) -> int:
        name, tmp = f"log/{commit['version']:010d}.json", self._at(f"log/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at("log"))
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(tmp, self._at(name)):
            raise RuntimeError(f"commit {commit['version']} is there already: another writer")
        return commit["version"]

    def _placed(self, rows: DataFrame, buckets: list[dict]) -> DataFrame:
        """rows with ``_n``, the number of their bucket: their last bits, looked up in the buckets' table, at most two rows of it a level of splits."""
        most = max(b["bits"] for b in buckets)
        slots = [(v, i) for i, b in enumerate(buckets) for v in range(b["value"], 1 << most, 1 << b["bits"])]
        table = self.spark.createDataFrame(slots, "_slot long, _n int")
        return rows.withColumn("_slot", F.xxhash64(*self.keys).bitwiseAND(F.lit((1 << most) - 1))).join(table, "_slot").drop("_slot")

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = F.struct(*[F.col(c) for c in self.schema.names if c not in self.keys])
        return rows.groupBy(*self.keys).agg(F.max_by(rest, self.arrival).alias("_r")).select(*self.keys, "_r.*").select(*self.schema.names)

    def _written(self, rows: DataFrame, version: int, split: list[dict]) -> list[dict]:
        """rows in new folders, one for each bucket of split that has any."""
        base = f"data/{version:010d}-{uuid.uuid4().hex[:8]}"
        placed = self._placed(rows, split)
        placed.repartition("_n").write.partitionBy("_n").parquet(f"{self.path}/{base}")
        counts = {r["_n"]: r["count"] for r in self.spark.read.parquet(f"{self.path}/{base}").groupBy("_n").count().collect()} if self._fs.exists(self._at(base)) and not rows.isEmpty() else {}
        return [{**b, "folder": f"{base}/_n={i}" if i in counts else None, "rows": counts.get(i, 0)} for i, b in enumerate(split)]

    def _split(self, bucket: dict, rows: int) -> list[dict]:
        """bucket, or as many halves of it as rows ask for."""
        more = max(0, (max(rows, 1) - 1) // self.bucket_rows).bit_length()
        return [{"bits": bucket["bits"] + more, "value": bucket["value"] + (k << bucket["bits"])} for k in range(1 << more)]

    def upsert(self, batch: DataFrame, tag: tuple[str, int] | None = None) -> int:
        """Commits the rows of batch that are later than those of their keys; returns the version.

        Only the buckets of the batch are read and written anew. tag: a source and the number of its batch; one that is
        not above the last of its source has been committed before and changes nothing."""
        now = self.commit_of()
        if tag and now["tags"].get(tag[0], -1) >= tag[1]:
            return now["version"]
        new = self._latest(batch.select(*self.schema.names))
        counts = {r["_n"]: r["count"] for r in self._placed(new, now["buckets"]).groupBy("_n").count().collect()}  # a row for each bucket
        kept = [b for i, b in enumerate(now["buckets"]) if i not in counts]
        touched = [now["buckets"][i] for i in sorted(counts)]
        split = [x for i in sorted(counts) for x in self._split(now["buckets"][i], now["buckets"][i]["rows"] + counts[i])]
        version = now["version"] + 1
        if split:
            # slots of untouched buckets have no rows here, so the new folders are looked up among all
            rows = self._latest(self._rows_of(touched).unionByName(new))
            made = self._written(rows, version, [*split, *({**b, "folder": None} for b in kept)])[: len(split)]
            kept = [*kept, *made]
        return self._log({"version": version, "tags": {**now["tags"], **({tag[0]: tag[1]} if tag else {})}, "buckets": kept})

    def compact(self) -> int:
        """Commits the same rows with buckets as the rows ask for: halves that have become small are one again."""
        now = self.commit_of()
        split = self._split({"bits": 0, "value": 0}, sum(b["rows"] for b in now["buckets"]))
        return self._log({"version": now["version"] + 1, "tags": now["tags"], "buckets": self._written(self._rows_of(now["buckets"]), now["version"] + 1, split)})

    def expire(self, keep: int = 1) -> list[str]:
        """Forgets all but the last commits and removes the folders that none of those names, with what runs that died have left; returns their names. Readers of older commits must have ended."""
        there = self.versions()
        gone, stay = there[:-keep] if keep else there, there[-keep:] if keep else []
        live = {b["folder"] for v in stay for b in self.commit_of(v)["buckets"] if b["folder"]}
        for v in gone:
            self._fs.delete(self._at(f"log/{v:010d}.json"), False)
        removed = []
        for x in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            base = f"data/{x.getPath().getName()}"
            for y in self._fs.listStatus(x.getPath()):
                name = f"{base}/{y.getPath().getName()}"
                if y.isDirectory() and name not in live:
                    self._fs.delete(y.getPath(), True)
                    removed.append(name)
            if not any(f.startswith(f"{base}/") for f in live):
                self._fs.delete(x.getPath(), True)
        return sorted(removed)
