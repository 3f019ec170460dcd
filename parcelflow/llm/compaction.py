"""Sharding by size-tiered compaction: small immutable runs are appended, runs of like size merged, manifests versioned."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import new_dir

#: Bytes of a full file, runs of a tier that are merged, smallest tier's bytes, versions that stay readable.
TARGET, FANOUT, BASE, KEEP = 128 << 20, 4, 1 << 20, 2


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A folder of immutable Parquet runs and of manifests v00000001.json, v00000002.json, ...

    A manifest lists the runs that make up the table at its version; readers use the highest one and never see half of a
    change. A commit writes a file aside and renames it to the next version, which fails if that version exists, so of
    two writers one wins and the other gets Conflict.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(self.conf)
        self.fs.mkdirs(self._at("manifest"))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("manifest"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def runs(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        source = self.fs.open(self._at(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def commit(self, runs: list[dict], after: int) -> int:
        aside = self._at(f"manifest/.{uuid.uuid4().hex}")
        sink = self.fs.create(aside, False)
        sink.write(bytearray(json.dumps(runs).encode()))
        sink.close()
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf).rename(aside, self._at(f"manifest/v{after + 1:08d}.json"), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(aside, False)
            if self.version() > after:
                raise Conflict(f"version {after + 1} exists") from e
            raise  # a folder that cannot be written, not another writer
        return after + 1

    def _run(self, folder: str) -> dict:
        files = [s for s in self.fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part-")]
        return {"path": folder, "bytes": sum(s.getLen() for s in files), "files": len(files)}

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """df as one new run, or as one run for each value of the column arrival, in one commit. Returns the version."""
        name, part = f"run-{uuid.uuid4().hex}", "_arrival"
        while part in self.schema.names:
            part += "_"
        rows = df.select(*(F.col(f"`{c}`") for c in self.schema.names), *([F.col(arrival).alias(part)] if arrival else []))
        if arrival:
            rows.write.partitionBy(part).parquet(f"{self.path}/{name}")
            new = [self._run(f"{name}/{s.getPath().getName()}") for s in self.fs.listStatus(self._at(name)) if s.isDirectory()]
        else:
            rows.write.parquet(f"{self.path}/{name}")
            new = [self._run(name)]
        while True:
            at = self.version()
            try:
                return self.commit(self.runs(at) + sorted((r for r in new if r["files"]), key=lambda r: r["path"]), at)
            except Conflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.runs(version))

    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{r['path']}" for r in runs))

    @staticmethod
    def tier(size: int, base: int = BASE, fanout: int = FANOUT) -> int:
        return 0 if size < base else 1 + int(math.log(size / base, fanout))

    def compact(self, target: int = TARGET, fanout: int = FANOUT, base: int = BASE) -> int:
        """Merges runs of one tier, fanout or more at a time, until no tier has so many. Returns the last version.

        A merge reads the runs' files side by side and writes files of about target bytes, without a shuffle. Runs whose
        files have all the target size are left alone. Each merge is one commit; a failed one leaves the version before.
        """
        while True:
            at = self.version()
            runs = self.runs(at)
            tiers: dict[int, list[dict]] = {}
            for r in runs:
                if r["bytes"] / max(1, r["files"]) < target / 2 or r["bytes"] < target:
                    tiers.setdefault(self.tier(r["bytes"], base, fanout), []).append(r)
            ready = [(t, rs) for t, rs in sorted(tiers.items()) if len(rs) >= fanout]
            if not ready:
                return at
            merged = ready[0][1]
            name = f"run-{uuid.uuid4().hex}"
            files = max(1, math.ceil(sum(r["bytes"] for r in merged) / target))
            self._read(merged).coalesce(files).write.parquet(f"{self.path}/{name}")
            gone = {r["path"] for r in merged}
            try:
                self.commit([r for r in runs if r["path"] not in gone] + [self._run(name)], at)
            except Conflict:
                self.fs.delete(self._at(name), True)

    def vacuum(self, keep: int = KEEP, older_than_s: int = 0) -> None:
        """Deletes manifests older than the last `keep`, and every run that none of those kept lists: those of older versions,
        and those that a failed append or merge has left.

        A reader holds the version that it began with as long as `keep` later ones are not all committed; older_than_s spares
        runs that were written since, such as those of an append that is not yet committed. With other writers about it must
        be longer than any append takes.
        """
        last = self.version()
        first = max(1, last - keep + 1)
        held = {r["path"] for v in range(first, last + 1) for r in self.runs(v)}
        for s in self.fs.listStatus(self._at("manifest")):
            name = s.getPath().getName()
            if name.startswith("v") and name.endswith(".json") and int(name[1:-5]) < first:
                self.fs.delete(s.getPath(), False)
        begun = {p.split("/")[0] for p in held}
        before = (time.time() - older_than_s) * 1000
        for s in self.fs.listStatus(self.root):
            name = s.getPath().getName()
            if not name.startswith("run-") or s.getModificationTime() > before:
                continue
            if name not in begun:
                self.fs.delete(s.getPath(), True)
            elif name not in held:  # some of its arrivals are merged
                for x in self.fs.listStatus(s.getPath()):
                    if x.isDirectory() and f"{name}/{x.getPath().getName()}" not in held:
                        self.fs.delete(x.getPath(), True)


def compacted(docs: DataFrame, arrival: str, path: str | None = None, target: int = TARGET) -> DataFrame:
    """docs appended to a new store, a run for each value of the column arrival, compacted, and read back by its manifest.

    Rows and values are those of docs, repeated rows and nulls included (null arrivals are a run of their own); the
    column arrival is left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([f for f in docs.schema.fields if f.name != arrival])
    store = ShardStore(spark, path or new_dir(spark, "shards"), schema)
    store.append(docs, arrival)
    store.compact(target)
    store.vacuum()
    return store.read()
