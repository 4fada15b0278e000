"""Sharding by size-tiered compaction under a versioned manifest. DataFrame functions only; no Python on executors.

A store is a folder of immutable Parquet shards and a manifest a version. An append writes the arrivals as small
shards, one a task. Compaction puts shards into tiers by size, and while a tier holds ``fan_in`` shards it merges
runs of them, in arrival order, into one; shards of at least the target size are sealed and left alone. A merge
reads the files of its run in one task and writes one file of about the target size at most twice over, so no shuffle moves the rows.
Merged shards are written beside the old ones and become visible with the next manifest.

A commit is the rename of a finished manifest file to its version's name, which fails if that version exists. A
reader takes one manifest and sees whole versions only; a job that is lost leaves files that no manifest names,
and a writer that loses a race starts over from the newer version. Old shards stay for readers of old versions
until ``vacuum``. A writer notes its intent before it makes a folder and takes the note away once the folder's shards are
committed; ``vacuum`` spares folders with a note younger than ``grace``, so what a running writer will name stays.

Scale: the plan works on the manifest, a short line a shard. Rounds of merges run side by side. Each row is
rewritten once a tier, so the work grows with the logarithm of the size.

Defined cases: empty arrivals add no shard but a version, and an empty store reads as no rows; null rows, repeated rows and any columns are kept as
they are; columns must agree with the store's.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FAN_IN = 4
#: Seconds after which a writer that left a note of intent counts as lost.
GRACE = 7 * 24 * 3600
#: Merges that run side by side.
LANES = 8


@dataclass(frozen=True)
class Shard:
    """One immutable file: its path below the store, bytes, rows, the tier it was merged into, and its first arrival."""

    path: str
    bytes: int
    rows: int
    level: int
    arrival: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    arrivals: int


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards of one table below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.smallest, self.fan_in = target, smallest, fan_in
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version, the newest by default; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, (), 0)
        lines = self.spark.read.text(self._manifest(version), wholetext=True).first()[0].splitlines()
        head, *shards = [json.loads(x) for x in lines]
        return Manifest(version, tuple(Shard(**s) for s in shards), head["arrivals"])

    def commit(self, base: Manifest, shards: list[Shard], arrivals: int) -> Manifest:
        """Publishes the version after base, or raises CommitConflict."""
        new = Manifest(base.version + 1, tuple(sorted(shards, key=lambda s: (s.arrival, s.path))), arrivals)
        draft = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray("\n".join([json.dumps({"arrivals": arrivals}), *[json.dumps(asdict(s)) for s in new.shards]]), "utf-8"))
        out.close()
        final = self._path(self._manifest(new.version))
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, options)
        except Exception as lost:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise CommitConflict(f"version {new.version} is there already") from lost
            raise
        return new

    def _intent(self, folder: str):
        return self._path(f"{self.root}/_intent/{folder.removeprefix('data/')}")

    def _forget(self, folders: set[str]) -> None:
        for folder in folders:
            self.fs.delete(self._intent(folder), False)

    def _write(self, df: DataFrame, level: int, arrival: int, by: str | None = None) -> list[Shard]:
        """Writes df as it is partitioned; one shard a file with rows. With a column ``by``, apart for each of its values, in their order."""
        folder = f"data/{uuid.uuid4().hex}"
        self.fs.create(self._intent(folder), False).close()
        (df.write if by is None else df.write.partitionBy(by)).parquet(f"{self.root}/{folder}")
        top = self._path(f"{self.root}/{folder}")
        parts = [""] if by is None else [s.getPath().getName() for s in self.fs.listStatus(top) if s.isDirectory()]
        parts.sort(key=lambda p: (len(p), p))
        files = [(f"{p}/{s.getPath().getName()}".lstrip("/"), s.getLen()) for p in parts for s in sorted(
            self.fs.listStatus(self._path(f"{self.root}/{folder}/{p}".rstrip("/"))), key=lambda s: s.getPath().getName()) if s.getPath().getName().endswith(".parquet")]
        if not files:
            self._forget({folder})
            return []
        schema = df.drop(by).schema if by else df.schema
        counted = self.spark.read.schema(schema).parquet(*[f"{self.root}/{folder}/{f}" for f, _ in files]).groupBy(F.input_file_name().alias("f")).count()
        rows = {"/".join(r["f"].split("/")[-1 if by is None else -2 :]): r["count"] for r in counted.collect()}  # a row a file
        return [Shard(f"{folder}/{name}", size, rows[name], level, arrival + k) for k, (name, size) in enumerate(files) if rows.get(name)]

    def append(self, df: DataFrame) -> Manifest:
        """Adds the rows as new shards, one for each partition with rows, in a new version."""
        base = self.manifest()
        return self._added(base, self._write(df, 0, base.arrivals))

    def append_each(self, df: DataFrame, by: str) -> Manifest:
        """Adds several arrivals in one pass: the rows of each value of the column ``by``, which is not kept, in a version of their own."""
        base = self.manifest()
        made: dict[str, list[Shard]] = {}
        for s in self._write(df, 0, base.arrivals, by):
            made.setdefault(s.path.split("/")[2], []).append(s)
        folders = {_folder(s) for held in made.values() for s in held}
        for held in made.values():
            base = self._added(base, held, forget=False)
        self._forget(folders)
        return base

    def _added(self, base: Manifest, shards: list[Shard], forget: bool = True) -> Manifest:
        while True:
            try:
                new = self.commit(base, [*base.shards, *shards], max([base.arrivals, *[s.arrival + 1 for s in shards]]))
                break
            except CommitConflict:
                base = self.manifest()
        if forget:
            self._forget({_folder(s) for s in shards})
        return new

    def tier(self, shard: Shard) -> int:
        """0 for the smallest shards, one more for each ``fan_in`` times the size."""
        tier, edge = 0, self.smallest
        while shard.bytes > edge:
            tier, edge = tier + 1, edge * self.fan_in
        return tier

    def merges(self, manifest: Manifest) -> list[list[Shard]]:
        """Runs to merge now: of each tier with ``fan_in`` unsealed shards, in arrival order, up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(manifest.shards, key=lambda s: (s.arrival, s.path)):
            if s.bytes < self.target:
                tiers.setdefault(self.tier(s), []).append(s)
        runs = []
        for held in tiers.values():
            if len(held) < self.fan_in:
                continue
            run: list[Shard] = []
            for s in held:
                run.append(s)
                if sum(x.bytes for x in run) >= self.target:
                    runs.append(run)
                    run = []
            if len(run) >= 2:
                runs.append(run)
        return [r for r in runs if len(r) >= 2]

    def _merged(self, run: list[Shard], schema) -> list[Shard]:
        files = [f"{self.root}/{s.path}" for s in run]
        df = self.spark.read.schema(schema).parquet(*files).coalesce(1)
        return self._write(df, max(s.level for s in run) + 1, min(s.arrival for s in run))

    def compact(self) -> Manifest:
        """Merges tier by tier until no tier is full; a version for each round."""
        base = self.manifest()
        while runs := self.merges(base):
            schema = self.read(base).schema
            with ThreadPoolExecutor(LANES) as lanes:
                made = list(lanes.map(lambda r: self._merged(r, schema), runs))
            gone = {s.path for r in runs for s in r}
            while True:
                new = [s for s in base.shards if s.path not in gone] + [s for m in made for s in m]
                try:
                    base = self.commit(base, new, base.arrivals)
                    self._forget({_folder(s) for m in made for s in m})
                    break
                except CommitConflict:
                    base = self.manifest()
                    if not gone <= {s.path for s in base.shards}:  # another compaction took them
                        self._forget({_folder(s) for m in made for s in m})
                        break
        return base

    def read(self, manifest: Manifest | None = None, schema=None) -> DataFrame:
        """All rows of a version, the newest by default. An empty version has the columns of ``schema`` and no rows."""
        manifest = manifest or self.manifest()
        if not manifest.shards:
            if schema is None:
                raise ValueError("the store is empty, so its columns must be given")
            return self.spark.createDataFrame([], schema)
        first = f"{self.root}/{manifest.shards[0].path}"
        schema = self.spark.read.parquet(first).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in manifest.shards])

    def vacuum(self, keep_versions: int = 2, grace: float = GRACE) -> int:
        """Deletes folders of shards that none of the last versions name and no writer is about to name; returns how many.

        Folders are listed first, then the notes of intent, then the manifests: a folder without a note is by then in a manifest or lost.
        """
        folder, notes = self._path(f"{self.root}/data"), self._path(f"{self.root}/_intent")
        found = [s.getPath() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        noted = {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(notes)} if self.fs.exists(notes) else {}
        held = {name for name, since in noted.items() if time.time() - since < grace}
        kept = {_folder(s) for v in self.versions()[-keep_versions:] for s in self.manifest(v).shards}
        gone = [p for p in found if f"data/{p.getName()}" not in kept and p.getName() not in held]
        for path in gone:
            self.fs.delete(path, True)
        self._forget({f"data/{name}" for name in noted if name not in held})
        return len(gone)


def _folder(shard: Shard) -> str:
    """The folder, below the store, that one write made."""
    return "/".join(shard.path.split("/")[:2])


def placed(store: ShardStore, manifest: Manifest, columns: list, schema=None) -> DataFrame:
    """The given columns of every row with the number, level, bytes and rows of the shard that holds it.

    Shards are numbered in arrival order. The manifest, a line a shard, is joined by file path.
    """
    spark = store.spark
    lines = [("/".join(s.path.split("/")[1:]), n, s.level, s.bytes, s.rows) for n, s in enumerate(manifest.shards)]
    table = spark.createDataFrame(lines, "shard_file string, shard_id int, level int, shard_bytes long, shard_rows long")
    rows = store.read(manifest, schema)
    at = F.regexp_extract(F.input_file_name(), "/data/([^/]+/.*)$", 1) if manifest.shards else F.lit(None).cast("string")
    rows = rows.select(*columns, at.alias("file_of"))
    return rows.join(table, F.col("file_of") == F.col("shard_file")).drop("file_of", "shard_file")
