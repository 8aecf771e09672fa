"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are written as small Parquet shards. A tier holds shards of similar size (each FAN times the one
below, from SMALLEST on), by their real size; a shard of half the target size or more is done. When a tier has FAN shards or more
they are one run; a run counts as a shard of its whole size, so that it may fill the next tier in turn, and only then is
each run rewritten, once, into shards of about the target size, or one where it holds less. Shards are never changed: a
compaction writes new files, then commits a version that names them in place of the old ones.

A commit writes the version's file beside its place and renames it, which fails if that version exists: so of two
writers one wins and the other starts over from the new version. Readers always see one version in whole. A version's
file holds what it adds and takes away; every SNAPSHOT-th holds all shards, so a commit costs what it changes. Old shards stay for those who
read an older version; `vacuum` removes what none of the last KEEP_VERSIONS versions names, and only files older than KEEP_SECONDS, so
that an append that has written but not yet committed loses nothing. A job lost midway leaves files that no version names.

Everything goes through Spark's readers and writers and Hadoop's file system, so the store may be any that
the cluster shares. A run is read by as few tasks as give target-sized shards: no shuffle.

Defined results: null values, empty and very long texts, ties, repeated rows and further columns pass as they
are, an empty arrival adds no shard and no version. Columns of one store keep one schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, table

FAN = 4
SMALLEST, TARGET = 1 << 16, 64 << 20
ARRIVAL_ROWS = 2_000
SNAPSHOT = 16
KEEP_VERSIONS, KEEP_SECONDS = 8, 86_400


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fan: int = FAN):
        self.spark, self.root, self.target, self.smallest, self.fan = spark, root.rstrip("/"), target, smallest, fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def tier(self, size: int) -> int:
        return 0 if size <= self.smallest else math.ceil(math.log(size / self.smallest, self.fan))

    def done(self, size: int) -> bool:
        """Whether a shard has about the target size; it is merged no more."""
        return 2 * size >= self.target

    def _listed(self, folder: str) -> list:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(self._fs.listStatus(self._path(folder)), key=lambda x: x.getPath().toString())

    def _file(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}.json"

    def version(self) -> int:
        names = (x.getPath().getName() for x in self._listed(f"{self.root}/versions"))
        return max((int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version: the last snapshot up to it, and what came and went since."""
        version = self.version() if version is None else version
        steps: list[dict] = []
        while version and not (steps and steps[-1]["whole"]):
            steps.append(json.loads(self.spark.read.text(self._file(version), wholetext=True).first()[0]))
            version -= 1
        held: dict[str, int] = {}
        for x in reversed(steps):
            for path in x["gone"]:
                held.pop(path, None)
            held |= {y["path"]: y["bytes"] for y in x["added"]}
        return [Shard(p, n) for p, n in held.items()]

    def commit(self, base: int, added: list[Shard], gone: list[str] = []) -> int:  # noqa: B006
        """Version base + 1, or Conflict if it exists already."""
        whole = (base + 1) % SNAPSHOT == 1
        if whole and base:
            out = set(gone)
            added, gone = [x for x in self.manifest(base) if x.path not in out] + added, []
        text = json.dumps({"version": base + 1, "whole": whole, "added": [asdict(x) for x in added], "gone": gone})
        jvm = self.spark._jvm
        draft, final = self._path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}"), self._path(self._file(base + 1))
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(draft, final, how)
        except Exception as e:
            self._fs.delete(draft, False)
            if self.version() > base:
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _written(self, rows: DataFrame, most_rows: int = 0) -> list[Shard]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", most_rows).parquet(folder)
        return [Shard(x.getPath().toString(), x.getLen()) for x in self._listed(folder) if x.getPath().getName().endswith(".parquet")]

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Arrivals as small shards, none of more than arrival_rows rows."""
        if rows.isEmpty():
            return self.version()
        new = self._written(rows, arrival_rows)
        while True:
            try:
                return self.commit(self.version(), new)
            except Conflict:
                continue

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What is to be merged: from the lowest tier up, FAN runs or more of a tier become one, which counts by its size from then on."""
        tiers: dict[int, list[list[Shard]]] = {}
        size = lambda run: sum(x.bytes for x in run)
        for x in shards:
            if not self.done(x.bytes):
                tiers.setdefault(self.tier(x.bytes), []).append([x])
        out: list[list[Shard]] = []
        while tiers:
            t = min(tiers)
            held = tiers.pop(t)
            if len(held) < self.fan:
                out += held
                continue
            run = [x for r in held for x in r]
            if self.done(size(run)) or self.tier(size(run)) <= t:
                out.append(run)
            else:
                tiers.setdefault(self.tier(size(run)), []).append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> int:
        """Rewrites each run once and commits them together; again until no tier is full."""
        while True:
            base = self.version()
            todo = self.runs(self.manifest(base))
            if not todo:
                return base
            new: list[Shard] = []
            for run in todo:
                parts = max(1, round(sum(x.bytes for x in run) / self.target))
                new += self._written(self.spark.read.parquet(*[x.path for x in run]).coalesce(parts))
            try:
                self.commit(base, new, [x.path for run in todo for x in run])
            except Conflict:
                continue

    def vacuum(self, versions: int = KEEP_VERSIONS, seconds: float = KEEP_SECONDS) -> int:
        """Removes files older than some seconds that none of the newest versions names, and gives their number."""
        newest, gone = self.version(), 0
        named = {x.path for v in range(max(1, newest - versions + 1), newest + 1) for x in self.manifest(v)}
        for folder in self._listed(f"{self.root}/shards"):
            for x in self._listed(folder.getPath().toString()):
                path = x.getPath()
                if path.getName().endswith(".parquet") and path.toString() not in named and x.getModificationTime() / 1000 <= time.time() - seconds:
                    gone += bool(self._fs.delete(path, False))
        return gone

    def read(self, version: int | None = None) -> DataFrame | None:
        shards = self.manifest(version)
        return self.spark.read.parquet(*[x.path for x in shards]) if shards else None


def op4_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents appended and compacted, then read back: the shard, tier and version that hold each."""
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, fresh_dir(spark, "shards"))
    store.append(docs)
    version = store.compact()
    store.vacuum(1, 0)  # nobody else knows this store
    rows = store.read(version)
    if rows is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("shard"), F.lit(0).alias("tier"), F.lit(0).alias("version"), F.lit(0).cast("long").alias("n_bytes"))
    tiers = spark.createDataFrame([(x.path.rpartition("/")[2], store.tier(x.bytes)) for x in store.manifest(version)], "shard string, tier int")
    held = rows.select("doc_id", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"), F.octet_length("text").cast("long").alias("n_bytes"))
    return held.join(tiers, "shard").select("doc_id", "shard", "tier", F.lit(version).alias("version"), "n_bytes")
