"""A shard store with size-tiered compaction. DataFrame reads and writes only; metadata goes through Hadoop's file systems."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a compacted shard, rows of an arriving one, size classes: a tier holds shards up to FAN_IN times those of the tier below.
TARGET, ARRIVAL_ROWS, SMALLEST, FAN_IN = 128 << 20, 4096, 256 << 10, 4


class Conflict(Exception):
    """Another writer committed the version first; the caller may try again on the new one."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    size: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    schema: str  # JSON of the rows' type; empty before the first append

    def text(self) -> str:
        return "\n".join(json.dumps(x) for x in ({"version": self.version, "schema": self.schema}, *map(asdict, self.shards)))

    @classmethod
    def parse(cls, text: str) -> Manifest:
        head, *rows = map(json.loads, text.splitlines())
        return cls(head["version"], tuple(Shard(**r) for r in rows), head["schema"])


class ShardStore:
    """Immutable Parquet shards under a folder, named by manifests of which version N is the file manifest/N.

    A manifest is written whole under a name of its own and renamed to its number; the rename fails if that number
    exists, so a version has one author and a reader sees all of a version or nothing of it. The store must be able to refuse that
    rename in one step, as HDFS does; on a local file system a hard link does it; plain object stores can't. Shards that no manifest names are
    invisible; a job that dies leaves only such shards, and vacuum() finds them.
    """

    def __init__(self, spark: SparkSession, path: str, *, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN, arrival_rows: int = ARRIVAL_ROWS):
        self.spark, self.path, self.target, self.smallest, self.fan_in, self.arrival_rows = spark, path.rstrip("/"), target, smallest, fan_in, arrival_rows
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fan_in)) + 1)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at("manifest")))
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version or the last one; version 0 is the empty store."""
        every = self.versions()
        if version is None:
            version = every[-1] if every else 0
        if version == 0:
            return Manifest(0, (), "")
        stream = self._fs.open(self._at(f"manifest/{version:010d}"))
        try:
            return Manifest.parse(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, new: Manifest) -> Manifest:
        own = self._at(f"manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, True)
        stream.write(new.text().encode())
        stream.close()
        jvm, target = self.spark._jvm, self._at(f"manifest/{new.version:010d}")
        try:
            if self._fs.getUri().getScheme() == "file":
                # a local rename looks first and moves then; a hard link fails if the name is taken, in one step
                paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (target, own)]
                jvm.java.nio.file.Files.createLink(*paths)
                self._fs.delete(own, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(own, target, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.version} exists") from e
            raise
        return new

    def _written(self, folder: str) -> tuple[Shard, ...]:
        """The shards a finished job left in a folder; file names and sizes only."""
        found = (s for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part-"))
        return tuple(sorted((Shard(f"{folder}/{s.getPath().getName()}", n := s.getLen(), self.tier(n)) for s in found), key=lambda s: s.path))

    def _write(self, df: DataFrame, rows: int = 0) -> tuple[Shard, ...]:
        folder = f"shards/{uuid.uuid4().hex[:12]}"
        df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._written(folder)

    def append(self, df: DataFrame) -> Manifest:
        """Add rows as small immutable shards, at most arrival_rows rows each, in one new version.

        The first append fixes the columns; a later one may lack some (nulls) and may bring new ones, but not other types of
        known ones (ValueError). An empty table makes a version without new shards. Rows may repeat.
        """
        now = self.manifest()
        schema = df.schema
        if now.schema:
            old = {f.name: f for f in T.StructType.fromJson(json.loads(now.schema))}
            for f in schema:
                if f.name in old and old[f.name].dataType != f.dataType:
                    raise ValueError(f"column {f.name} is {old[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            schema = T.StructType([*old.values(), *(f for f in schema if f.name not in old)])
        new = self._write(df, self.arrival_rows)
        try:
            return self.commit(Manifest(now.version + 1, now.shards + new, json.dumps(schema.jsonValue())))
        except Conflict:
            self._discard(new)
            raise

    def compact(self) -> Manifest:
        """Merge tiers with at least fan_in runs below the target into files of about the target size; one new version a merge, or none.

        Tiers are taken from below; what a merge makes may fill the next tier, so this repeats until no tier is full. A tier that can't be packed
        closer, for instance as the scan's own limit is smaller, is left as it is and the next ones have their turn. A merge is a scan
        that packs whole small files into partitions of the target size and writes each as one shard: no shuffle. If another writer
        commits first (Conflict), the merged shards are deleted.
        """
        tight: set[frozenset[str]] = set()  # runs that could not be packed closer
        while True:
            now = self.manifest()
            tiers: dict[int, list[Shard]] = {}
            for s in now.shards:
                if 2 * s.size < self.target:
                    tiers.setdefault(s.tier, []).append(s)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= self.fan_in and frozenset(s.path for s in tiers[t]) not in tight), None)
            if full is None:
                return now
            runs = tiers[full]
            # runs of the next tiers that are not full ride along if the merge alone would stay below the target
            for t in sorted(k for k in tiers if k > full):
                if sum(s.size for s in runs) >= self.target:
                    break
                runs = runs + tiers[t]
            merged = self._merge(runs, now)
            if len(merged) >= len(runs):
                self._discard(merged)
                tight.add(frozenset(s.path for s in tiers[full]))
                continue
            gone = {s.path for s in runs}
            try:
                self.commit(Manifest(now.version + 1, tuple(s for s in now.shards if s.path not in gone) + merged, now.schema))
            except Conflict:
                self._discard(merged)
                raise

    def _discard(self, shards: tuple[Shard, ...]) -> None:
        """Delete the folders of shards that were never named by a manifest."""
        for folder in {s.path.rpartition("/")[0] for s in shards}:
            self._fs.delete(self._at(folder), True)

    def _merge(self, runs: list[Shard], now: Manifest) -> tuple[Shard, ...]:
        conf = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": str(max(1, round(sum(s.size for s in runs) / self.target)))}
        before = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            return self._write(self._read(runs, now))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _read(self, shards, now: Manifest) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now.schema))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        now = self.manifest(version)
        return self._read(now.shards, now)

    def located(self, version: int | None = None) -> DataFrame:
        """read(), with shard (its path in the store), shard_bytes and manifest_version."""
        now = self.manifest(version)
        rows = self._read(now.shards, now)
        if not now.shards:
            return rows.withColumns({"shard": F.lit(None).cast("string"), "shard_bytes": F.lit(None).cast("long"), "manifest_version": F.lit(now.version)})
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"(shards/[^/]+/[^/]+)$", 1).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(now.version).alias("manifest_version"))

    def vacuum(self, keep: int = 1, grace_s: float = 86_400.0) -> int:
        """Delete shards that none of the last `keep` (at least 1) versions names, and older manifests; returns how many shards went.

        Those that older versions named go at once. Folders that no manifest names are of jobs that died, or still run: they go once nothing in
        them, nor a manifest's own unfinished file, was changed for grace_s seconds.
        """
        if keep < 1:
            raise ValueError("at least one version is kept")
        every = self.versions()
        live = {s.path for v in every[-keep:] for s in self.manifest(v).shards}
        dead = {s.path for v in every[:-keep] for s in self.manifest(v).shards} - live
        for path in dead:
            self._fs.delete(self._at(path), False)
        for v in every[:-keep]:
            self._fs.delete(self._at(f"manifest/{v:010d}"), False)
        known = {p.rpartition("/")[0] for p in live}
        before = (time.time() - grace_s) * 1000
        gone = len(dead)
        for s in self._listed("shards"):
            folder = f"shards/{s.getPath().getName()}"
            files = self._listed(folder)
            if folder not in known and all(f.getModificationTime() < before for f in [s, *files]):
                gone += sum(f.getPath().getName().startswith("part-") for f in files)
                self._fs.delete(self._at(folder), True)
        for s in self._listed("manifest"):
            if s.getPath().getName().startswith(".") and s.getModificationTime() < before:
                self._fs.delete(s.getPath(), False)
        return gone

    def _listed(self, folder: str) -> list:
        return list(self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []
