"""The versioned state: keyed tables in buckets, append-only logs merged in tiers, one manifest a version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.sources.files import nothing

FILE_BYTES = 128 << 20


class StateStore:
    """Tables in versions. A version is one manifest, written after all its tables: a reader sees all of it or nothing.

    manifests/00000001.json, ... list each table's folders and how far the inputs have come; a write that fails leaves folders that
    no manifest lists, and its input is applied again in whole. There is one writer at a time; two that commit the same version
    are told apart by the manifest's name.

    Plain tables are replaced whole. Logs grow by a folder a commit; fan folders of one tier become one of the next, so a log of n
    commits has at most (fan - 1) * log(n) folders and each row is rewritten once a tier. Keyed tables are dealt to parts by their
    first key and to buckets by all of them, the last one first: a part has one value of the first key, so a join sorts its rows by the
    last. A commit replaces the parts that it names and leaves the files of the others alone.
    The last keep versions stay readable; what only older ones list is deleted every keep commits.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan: int = 8, keep: int = 16):
        self.spark, self.path, self.fan, self.keep = spark, path.rstrip("/"), fan, keep
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds, by default the last.

        high and items: the highest batch applied, and of that batch the items; buckets: of the keyed tables; tables and logs:
        {name: [[tier, folder], ...]}; keyed: {name: {part: folder}}; by: {name: keys that deal a keyed table to buckets}, which a table
        of an older version lacks, as it is dealt by its keys in order.
        """
        version = version or (self.versions() or [0])[-1]
        if not version:
            return {"high": -1, "items": [], "buckets": self.buckets, "tables": {}, "logs": {}, "keyed": {}, "by": {}}
        source = self.fs.open(self._at(f"manifests/{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def applied(self, tag: str, manifest: dict | None = None) -> bool:
        """Whether the input of a tag, batch or batch:item, is in. Batches come in ascending order, the items of one in any."""
        m = manifest or self.manifest()
        batch, _, item = tag.partition(":")
        return int(batch) < m["high"] or int(batch) == m["high"] and item in m["items"]

    @staticmethod
    def dealt_by(m: dict, table: str, keys: Sequence[str]) -> list[str]:
        """The keys in the order in which a table is dealt to buckets; a join on them in this order needs no shuffle."""
        return m.get("by", {}).get(table) or list(keys if table in m["keyed"] else reversed(keys))

    # reading

    @staticmethod
    def _part(value: str) -> str:
        return "p" + value.encode().hex()

    def _folders(self, m: dict, table: str, parts: Iterable[str] | None) -> list[str]:
        if table in m["keyed"]:
            own = m["keyed"][table]
            names = own if parts is None else [p for p in map(self._part, parts) if p in own]
            return [f"{table}/ver={own[p]}/part={p}" for p in names]
        return [folder for _, folder in [*m["tables"].get(table, []), *m["logs"].get(table, [])]]

    def read(self, table: str, schema: T.StructType | str, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """A table as of a version; of a keyed one the named parts or all."""
        return self._scan(self._folders(self.manifest(version), table, parts), schema)

    def bucketed(self, table: str, schema: str, keys: Sequence[str], parts: Iterable[str]) -> DataFrame:
        """Parts of a keyed table for a join on its keys that does not shuffle them.

        One scan over the table's folder whose partition filter names the parts' versions; Spark knows the buckets from a table
        definition that lives only while the scan is resolved.
        """
        m = self.manifest()
        own = m["keyed"].get(table, {})
        named = [f"{own[p]}/{p}" for p in map(self._part, parts) if p in own]
        if not named:
            return nothing(self.spark, schema)
        setting, name = "spark.sql.hive.manageFilesourcePartitions", f"store_{uuid.uuid4().hex}"
        before = self.spark.conf.get(setting)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))
        self.spark.conf.set(setting, "false")  # partitions are found by their folders
        try:
            self.spark.sql(f"create table {name} ({columns}, ver string, part string) using parquet partitioned by (ver, part) clustered by ({', '.join(self.dealt_by(m, table, keys))}) into {m['buckets']} buckets location '{self.path}/{table}'")
            rows = self.spark.table(name)
            rows.schema  # noqa: B018, resolves the scan
            self.spark.sql(f"drop table {name}")
        finally:
            self.spark.conf.set(setting, before)
        return rows.where(F.concat("ver", F.lit("/"), "part").isin(named)).drop("ver", "part")

    # writing

    def _put(self, df: DataFrame, name: str, version: int, by: str | None = None) -> str:
        folder = f"{name}/{'ver=' * bool(by)}{version:08d}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{folder}")
        return folder

    def _scan(self, folders: list[str], schema: T.StructType | str) -> DataFrame:
        """The rows of folders of one table; those of logs by a column have it as a partition, so a filter on it skips files."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not folders:
            return nothing(self.spark, schema)
        paths = [f"{self.path}/{f}" for f in folders]
        if "/part=" in folders[0] or "/ver=" not in folders[0]:
            return self.spark.read.schema(schema).parquet(*paths)
        wide = T.StructType([*schema.fields, T.StructField("ver", T.StringType())])
        return self.spark.read.schema(wide).option("basePath", f"{self.path}/{folders[0].split('/')[0]}").parquet(*paths).select(*schema.names)

    def _merged(self, entries: list, name: str, version: int, schema: T.StructType, by: str | None) -> list:
        """entries of a log with every full tier merged into the next."""
        tier = 0
        while len(full := [f for t, f in entries if t == tier]) >= self.fan:
            size = sum(self.fs.getContentSummary(self._at(f)).getLength() for f in full)
            rows = self._scan(full, schema).coalesce(max(1, -(-size // FILE_BYTES)))
            entries = [[t, f] for t, f in entries if t != tier] + [[tier + 1, self._put(rows, name, version, by)]]
            tier += 1
        return entries

    def _keyed(self, df: DataFrame, name: str, keys: Sequence[str], by: Sequence[str], buckets: int, version: int, dealt: bool) -> dict[str, str]:
        """{part: folder of its version} of the rows' parts, by the first of keys, each dealt to buckets by the columns by; dealt: tasks have a bucket each already."""
        ver, table = f"{version:08d}-{uuid.uuid4().hex}", f"store_{uuid.uuid4().hex}"
        part = F.concat(F.lit("p"), F.lower(F.hex(F.col(keys[0]).cast("binary"))))
        rows = df.withColumn("part", part)
        out = (rows if dealt else rows.repartition(buckets, *by)).write.partitionBy("part").bucketBy(buckets, *by)
        out.option("path", f"{self.path}/{name}/ver={ver}").format("parquet").saveAsTable(table)
        self.spark.sql(f"drop table {table}")  # the files stay
        return {n.removeprefix("part="): ver for n in self._names(f"{name}/ver={ver}") if n.startswith("part=")}

    def commit(
        self, tag: str, replace: Mapping[str, DataFrame] | None = None, append: Mapping[str, DataFrame | tuple[DataFrame, str]] | None = None,
        keyed: Mapping[str, tuple] | None = None, dealt: Iterable[str] = (),
    ) -> int:
        """Writes the tables and then the next version's manifest. A tag that has been applied changes nothing. Returns the version.

        replace: whole tables; append: rows of logs, with the column that deals them to folders if there is one; keyed: (rows, keys, parts), where the rows are all that the parts hold from now on;
        columns after these deal a new table to buckets instead of its keys: by the first key alone a part is one file. dealt: keyed tables whose rows come from
        a join of tables in the same buckets, so that they are not shuffled again; were they dealt otherwise, a bucket would have more files.
        """
        m, version = self.manifest(), (self.versions() or [0])[-1]
        if self.applied(tag, m):
            return version
        new = version + 1
        for name, df in (replace or {}).items():
            m["tables"][name] = [[0, self._put(df, name, new)]]
        for name, given in (append or {}).items():
            df, by = given if isinstance(given, tuple) else (given, None)
            m["logs"][name] = self._merged([*m["logs"].get(name, []), [0, self._put(df, name, new, by)]], name, new, df.schema, by)
        for name, (df, keys, parts, *given) in (keyed or {}).items():
            kept = {p: ver for p, ver in m["keyed"].get(name, {}).items() if p not in set(map(self._part, parts))}
            by = list(given) if given and name not in m["keyed"] else self.dealt_by(m, name, keys)
            m["keyed"][name], m.setdefault("by", {})[name] = kept | self._keyed(df, name, keys, by, m["buckets"], new, name in dealt), by
        batch, _, item = tag.partition(":")
        m["items"] = [*(m["items"] if int(batch) == m["high"] else []), item]
        m["high"] = int(batch)
        aside = self._at(f"manifests/.{uuid.uuid4().hex}")
        sink = self.fs.create(aside, False)
        sink.write(bytearray(json.dumps(m).encode()))
        sink.close()
        if not self.fs.rename(aside, self._at(f"manifests/{new:08d}.json")):
            raise RuntimeError(f"version {new} exists")
        if new % self.keep == 0:
            self.vacuum()
        return new

    def vacuum(self) -> None:
        """Deletes the manifests before the last keep ones, and the folders of finished versions that no kept manifest lists."""
        versions = self.versions()
        used: set[str] = set()
        for v in versions[-self.keep :]:
            m = self.manifest(v)
            for name in [*m["tables"], *m["logs"], *m["keyed"]]:
                used.update(self._folders(m, name, None))
        for name in [n for n in self._names("") if n != "manifests"]:
            for folder in self._names(name):
                if not folder.removeprefix("ver=")[:8].isdigit() or int(folder.removeprefix("ver=")[:8]) > versions[-1]:
                    continue
                at = f"{name}/{folder}"
                inner = [f"{at}/{p}" for p in self._names(at) if p.startswith("part=")] if folder.startswith("ver=") else [at]
                stale = [f for f in inner if f not in used]
                for f in [at] if len(stale) == len(inner) else stale:
                    self.fs.delete(self._at(f), True)
        for v in versions[: -self.keep]:
            self.fs.delete(self._at(f"manifests/{v:08d}.json"), False)
