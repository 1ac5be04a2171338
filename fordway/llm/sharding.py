"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder of immutable Parquet files and manifests. append() writes an arrival as it comes, without a
shuffle: each task's rows become small files of at most `most_rows` rows. compact() groups live files by tier, the
logarithm of their bytes of text; where a tier has `fanout` files or more, they are merged in order of arrival into
files of about `target` bytes, tier by tier until no tier is full. The whole cascade is planned over the manifest
first, so each row is moved once. Files of half the target to twice the target stay as they are; a larger one, of long
texts, is split by rows. Each file to be made is one task, named by its number and not by a hash.

A version is a table of its live files (file, rows, bytes, low, high, tier) with the store's columns, written aside and
then renamed to its number; a rename onto an existing version fails, so of two writers one wins and the other plans
anew. That needs a file system whose rename is atomic and never overwrites, as HDFS and local disks have; an object
store needs a committer of its own. Readers of a version see its files until vacuum(). What comes to the driver is a
row for each file, never for each text.

Rows are moved as they are: null ids and texts (0 bytes), empty texts, repeated rows and columns of any names. Arrivals
may differ in columns: a version has the columns of all arrivals, null where a file lacks one. A column that comes with
another type than before is refused before anything is written. An empty arrival adds no file but its columns. A
file's rows are bounded by its arrival, a merged file's by the target, so one source or key with most rows is no
matter. A very long text lies in one file whatever the target.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from .common import Workspace, filesystem, shared_dir, table
from .groups import small

MANIFEST = "file string, rows long, bytes long, low string, high string, tier int, columns string"
DAY = 86_400


@dataclass(frozen=True)
class Shard:
    file: str  # below the store's folder
    rows: int
    bytes: int
    low: str | None  # least and greatest id, as text
    high: str | None
    tier: int


def tier_of(size: int, base: int, fanout: int) -> int:
    """0 up to base bytes, then one more for each factor of fanout."""
    tier = 0
    while size > base:
        size //= fanout
        tier += 1
    return tier


def plan(sizes: list[int], target: int, base: int, fanout: int) -> list[list[int]]:
    """Groups of places in `sizes` to merge, in order; each of two or more."""
    live: list[tuple[int, list[int]]] = [(s, [k]) for k, s in enumerate(sizes)]
    while True:
        tiers: dict[int, list[int]] = {}
        for at, (size, _) in enumerate(live):
            if size < target / 2:
                tiers.setdefault(tier_of(size, base, fanout), []).append(at)
        full = [t for t, members in sorted(tiers.items()) if len(members) >= fanout]
        if not full:
            return [m for _, m in live if len(m) > 1]
        merged, gone, size, group = {}, set(), 0, []
        for at in tiers[full[0]]:
            group.append(at)
            size += live[at][0]
            if size >= target:
                merged[group[0]] = (size, group)
                size, group = 0, []
        if len(group) > 1:
            merged[group[0]] = (size, group)
        for _, members in merged.values():
            gone.update(members)
        nxt = []
        for at, run in enumerate(live):
            if at in merged:
                size, members = merged[at]
                nxt.append((size, [k for x in members for k in live[x][1]]))
            elif at not in gone:
                nxt.append(run)
        live = nxt


def parts_of(sizes: list[int], rows: list[int], target: int) -> dict[int, int]:
    """Places of files over twice the target that have rows to share out, and into how many files."""
    return {k: min(-(-s // target), n) for k, (s, n) in enumerate(zip(sizes, rows, strict=True)) if s > 2 * target and n > 1}


def joined(old: StructType, new: StructType) -> StructType:
    """The old columns and then those only the new ones have."""
    known = {f.name.lower(): f for f in old}
    for f in new:
        have = known.get(f.name.lower())
        if have is not None and (have.name != f.name or have.dataType != f.dataType):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} does not fit {have.name} {have.dataType.simpleString()}")
    return StructType([*old, *(StructField(f.name, f.dataType) for f in new if f.name.lower() not in known)])


def own_path():
    """The path of a row's file below its store's folder; files of one task differ by folder only."""
    return F.regexp_extract(F.input_file_name(), "/(data-[0-9a-f]{32}/[^?]*)$", 1)


class Conflict(RuntimeError):
    """Another writer committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id", text_col: str = "text", target: int = 128 << 20, base: int = 1 << 20, fanout: int = 4, most_rows: int = 10_000):
        self.spark, self.root, self.id_col, self.text_col = spark, root.rstrip("/"), id_col, text_col
        self.target, self.base, self.fanout, self.most_rows = target, base, fanout, most_rows

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}"

    def _versions(self) -> list[int]:
        fs, at = filesystem(self.spark, f"{self.root}/manifests")
        if not fs.exists(at):
            return []
        return sorted(int(n[1:]) for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.startswith("v"))

    def version(self) -> int:
        """The latest version; 0 before the first."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        return self._rows(version).where("file is not null").drop("columns")

    def _rows(self, version: int | None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._manifest_path(version))

    def state(self, version: int | None = None) -> tuple[list[Shard], StructType]:
        """The live files, by name, and the columns of a version."""
        rows = self._rows(version).collect()
        columns = [StructType.fromJson(json.loads(r["columns"])) for r in rows if r["file"] is None]
        live = sorted((Shard(*tuple(r)[:-1]) for r in rows if r["file"] is not None), key=lambda s: s.file)
        return live, columns[0] if columns else StructType()

    def shards(self, version: int | None = None) -> list[Shard]:
        return self.state(version)[0]

    def commit(self, shards: list[Shard], columns: StructType, version: int) -> int:
        """Make `shards` the live files of `version`; Conflict if it exists."""
        jvm = self.spark.sparkContext._jvm
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        rows = [(s.file, s.rows, s.bytes, s.low, s.high, s.tier, None) for s in shards]
        rows.append((None, 0, 0, None, None, None, columns.json()))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(aside)
        _, to = filesystem(self.spark, self._manifest_path(version))
        _, source = filesystem(self.spark, aside)
        fs, parent = filesystem(self.spark, f"{self.root}/manifests")
        fs.mkdirs(parent)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(parent).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(source, to, never_over)
        except Exception as e:
            if fs.exists(to):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _files(self, shards: list[Shard], columns: StructType) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*[f"{self.root}/{s.file}" for s in shards])

    def _measured(self, folder: str, columns: StructType) -> list[Shard]:
        """The files of a folder below the root, with rows and bytes as read back."""
        read = self.spark.read.schema(columns).parquet(f"{self.root}/{folder}")
        size = F.coalesce(F.octet_length(self.text_col), F.lit(0)).cast("long")
        own = read.select(own_path().alias("f"), size.alias("b"), F.col(self.id_col).alias("i"))
        found = own.groupBy("f").agg(F.count("*").alias("rows"), F.sum("b").alias("bytes"), F.min("i").cast("string").alias("low"), F.max("i").cast("string").alias("high"))
        rows = found.select(F.col("f").alias("file"), "rows", "bytes", "low", "high").orderBy("file").collect()
        return [Shard(*x, tier_of(x["bytes"], self.base, self.fanout)) for x in rows]

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival and commit it as a new version."""
        joined(self.state()[1], arrival.schema)
        folder = f"data-{uuid.uuid4().hex}"
        writer = arrival.write.option("compression", "zstd").option("maxRecordsPerFile", self.most_rows)
        writer.parquet(f"{self.root}/{folder}")
        new = self._measured(folder, joined(StructType(), arrival.schema))
        while True:
            version = self.version()
            live, columns = self.state(version)
            try:
                return self.commit(live + new, joined(columns, arrival.schema), version + 1)
            except Conflict:
                continue

    def compact(self) -> int:
        """Merge full tiers, split files far over the target, and commit; the present version if there are none."""
        while True:
            version = self.version()
            live, columns = self.state(version)
            sizes = [s.bytes for s in live]
            work = [([live[k] for k in g], 1) for g in plan(sizes, self.target, self.base, self.fanout)]
            work += [([live[k]], n) for k, n in parts_of(sizes, [s.rows for s in live], self.target).items()]
            if not work:
                return version
            made = self._remade(work, columns)
            gone = {s.file for g, _ in work for s in g}
            try:
                return self.commit([s for s in live if s.file not in gone] + made, columns, version + 1)
            except Conflict:
                continue

    def _remade(self, work: list[tuple[list[Shard], int]], columns: StructType) -> list[Shard]:
        """Write each group of files as so many files as it says, each by a task of its own, all in one job."""
        folder, run = f"data-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        of, n = [], 0
        for group, parts in work:
            of += [(s.file, n, parts) for s in group]
            n += parts
        where = self.spark.createDataFrame(of, f"{run}_file string, {run}_first int, {run}_parts int")
        # a row's number is the same whenever its file is read, so a task that runs again makes the same files
        read = self._files([s for g, _ in work for s in g], columns).withColumns({f"{run}_file": own_path(), f"{run}_row": F.monotonically_increasing_id()})
        placed = read.join(small(where, len(of)), f"{run}_file")
        at = (F.col(f"{run}_first") + F.pmod(F.col(f"{run}_row"), F.col(f"{run}_parts"))).cast("int")
        dealt = placed.withColumn(run, at).repartitionById(n, run)
        dealt.drop(run, *[f"{run}_{c}" for c in ("file", "row", "first", "parts")]).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._measured(folder, columns)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the columns of all arrivals up to it."""
        live, columns = self.state(version)
        if not columns.fields:
            raise ValueError("nothing was appended up to this version")
        return self._files(live, columns) if live else self.spark.createDataFrame([], columns)

    def vacuum(self, keep: int = 1, grace: int = DAY) -> None:
        """Remove all but the last `keep` versions, and the files that none of these names: merged ones, those of empty
        arrivals and of writers that failed. What is younger than `grace` seconds may be a writer's at work and stays
        unless a version that goes named it."""
        versions = self._versions()
        last, gone = versions[-keep:], versions[:-keep] if keep else []
        named = {s.file for v in last for s in self.shards(v)}
        former = {s.file for v in gone for s in self.shards(v)}
        before = (time.time() - grace) * 1000
        fs, at = filesystem(self.spark, self.root)
        for folder in fs.listStatus(at) if fs.exists(at) else ():
            name = folder.getPath().getName()
            if name not in ("manifests", "aside") and not name.startswith("data-"):
                continue
            for x in fs.listStatus(folder.getPath()) if name != "manifests" else ():
                file = f"{name}/{x.getPath().getName()}"
                if file not in named and (file in former or x.getModificationTime() <= before):
                    fs.delete(x.getPath(), True)
        for v in gone:
            fs.delete(filesystem(self.spark, self._manifest_path(v))[1], True)

    def remove(self) -> None:
        """The whole store."""
        fs, at = filesystem(self.spark, self.root)
        fs.delete(at, True)


def located(store: ShardStore) -> DataFrame:
    """id, shard, tier, version, n_bytes for each row of the latest version, as read back from its files."""
    version = store.version()
    live, columns = store.state(version)
    if not live:
        kind = columns[store.id_col].dataType.simpleString() if columns.fields else "long"
        return store.spark.createDataFrame([], f"`{store.id_col}` {kind}, shard int, tier int, version int, n_bytes long")
    rows = store._files(live, columns).select(F.col(store.id_col), own_path().alias("name"), F.coalesce(F.octet_length(store.text_col), F.lit(0)).cast("long").alias("n_bytes"))
    of = store.spark.createDataFrame([(s.file, k, s.tier) for k, s in enumerate(live)], "name string, shard int, tier int")
    return rows.join(small(of, len(live)), "name").select(store.id_col, "shard", "tier", F.lit(version).alias("version"), "n_bytes")


def arrivals(docs: DataFrame, n: int, id_col: str = "doc_id") -> list[DataFrame]:
    """A table in n parts: by its files, so that each is read once, or by a hash of the id where it has too few."""
    files = sorted(docs.inputFiles())
    if len(files) >= n:
        return [docs.sparkSession.read.schema(docs.schema).parquet(*files[k::n]) for k in range(n)]
    return [docs.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == k) for k in range(n)]


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents appended in four arrivals, each followed by a compaction, and vacuumed: where each row lies in the
    latest version, as read back. The store goes; the answer is a table in the shared folder."""
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    try:
        for arrival in arrivals(table(spark, sf_dir, "documents"), 4):
            store.append(arrival)
            store.compact()
            store.vacuum(grace=0)
        return Workspace(spark, "located").store(located(store), "rows")
    finally:
        store.remove()
