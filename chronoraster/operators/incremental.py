"""Only new or changed records: manifest diffs and committed outputs (problem 4)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions.session import join_small
from chronoraster.operators.standing import MAX_CUBES

KEY = ["cube_id", "label"]


def granule_label(g: DataFrame) -> Column:
    """A granule's date as YYYYDDD: ``raw_date``, else the AYYYYDDD of its file name."""
    name = F.nullif(F.regexp_extract("filename", r"\.A(\d{7})\.", 1), F.lit(""))
    return F.coalesce(F.date_format("raw_date", "yyyyDDD"), name)


def last_success(run_log: DataFrame) -> DataFrame:
    """(cube_id, processed_at, used) of each cube's last successful run.

    A run succeeded if its status is ``ok`` in any letter case.  Of equal times
    the greatest run_id counts.  used is the set of its trimmed, non-empty labels.
    """
    ok = run_log.where((F.lower(F.trim("status")) == "ok") & F.col("processed_at").isNotNull() & F.col("cube_id").isNotNull())
    last = ok.groupBy("cube_id").agg(F.max(F.struct("processed_at", "run_id", "rawdates")).alias("r"))
    used = F.transform(F.coalesce("r.rawdates", F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", "")))
    return last.select("cube_id", F.col("r.processed_at").alias("processed_at"), F.array_distinct(F.filter(used, lambda x: x.isNotNull() & (x != ""))).alias("used"))


# ---- table versions: manifests, deletion vectors and their difference
#
# A version of a table is a manifest: its data files, each with the number of its rows and a deletion vector, the
# positions of rows that do not count.  Files are immutable, so versions differ in files added, files removed and
# deletion vectors only, and no data file has to be read to tell which records changed.

MANIFEST = "path string, rows bigint, deleted array<bigint>"


def align(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new): the files of two manifests (keys, path, rows, deleted) side by side; null where a version has none."""
    file = F.struct("path", "rows", F.coalesce("deleted", F.array().cast("array<bigint>")).alias("deleted"))
    return old.select(*keys, file.alias("old")).join(new.select(*keys, file.alias("new")), keys, "full")


def with_deltas(aligned: DataFrame) -> DataFrame:
    """Adds ``deltas``, an array of (op, path, rows, skip), to rows with the structs ``old`` and ``new``.

    op is ``insert`` or ``delete``.  rows are the positions that it concerns, null
    for all of the file but those in ``skip``, which are subtracted when it is
    read.  A file that both versions have gives the positions by which its
    deletion vectors differ; one without a live row gives nothing.
    """
    kind = "array<struct<op:string,path:string,rows:array<bigint>,skip:array<bigint>>>"
    none, nothing = F.lit(None).cast("array<bigint>"), F.array().cast("array<bigint>")

    def whole(op: str, file: str) -> Column:
        live = F.col(file).isNotNull() & (F.size(f"{file}.deleted") < F.col(f"{file}.rows"))
        return F.when(live, F.array(F.struct(F.lit(op).alias("op"), F.col(f"{file}.path").alias("path"), none.alias("rows"), F.col(f"{file}.deleted").alias("skip")))).otherwise(F.array().cast(kind))

    def part(op: str, more: str, less: str) -> Column:
        rows = F.array_except(f"{more}.deleted", f"{less}.deleted")
        return F.when(F.size(rows) > 0, F.array(F.struct(F.lit(op).alias("op"), F.col("new.path").alias("path"), rows.alias("rows"), nothing.alias("skip")))).otherwise(F.array().cast(kind))

    same = F.col("old").isNotNull() & F.col("new").isNotNull() & F.col("old.path").eqNullSafe(F.col("new.path"))
    return aligned.withColumn("deltas", F.when(same, F.concat(part("delete", "new", "old"), part("insert", "old", "new"))).otherwise(F.concat(whole("delete", "old"), whole("insert", "new"))))


def manifest_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, path, rows, skip): record deltas between two versions of a table, given by their manifests (path, rows, deleted)."""
    named = [m.select("*", F.col("path").alias("__key")) for m in (old, new)]
    return with_deltas(align(*named, ["__key"])).select(F.explode("deltas").alias("d")).select("d.*")


def manifests(granules: DataFrame, run_log: DataFrame) -> DataFrame:
    """One row per (cube_id, label): its file in the processed version (``old``) and in the current one (``new``).

    A cube's version has one file a date, which holds that date's record; a file
    is known by its checksum, as one with equal content is no change.  The
    current version has the greatest proc_ts of all files, the processed one
    that of the files collected up to the last successful run; ties go to the
    greatest granule_id.  A label that the run did not use is in its file's
    deletion vector.  A label that the run used and that no file has any more
    has a file in the processed version only.  Both manifests come out of one
    partial aggregation over the files, aligned as they are.
    """
    runs = last_success(run_log)
    g = granules.select("cube_id", granule_label(granules).alias("label"), "proc_ts", "granule_id", "cksum", "collected_at").dropna(subset=KEY)
    g = join_small(g, runs.select("cube_id", "processed_at"), "cube_id", "left", MAX_CUBES)
    entry = F.struct("proc_ts", "granule_id", "cksum")
    files = g.groupBy(*KEY).agg(F.max(entry).alias("current"), F.max(F.when(F.col("collected_at") <= F.col("processed_at"), entry)).alias("processed"))
    used = runs.select("cube_id", F.explode("used").alias("label"), F.lit(True).alias("in_run"))
    files = files.join(used, KEY, "full")

    def file(of: str, deleted: Column) -> Column:
        return F.struct(F.col(f"{of}.cksum").cast("string").alias("path"), F.lit(1).cast("bigint").alias("rows"), deleted.cast("array<bigint>").alias("deleted"), F.col(f"{of}.granule_id").alias("granule_id"))

    unused = F.when(F.col("in_run").isNull(), F.array(F.lit(0))).otherwise(F.array())
    old = F.when(F.col("processed").isNotNull() | F.col("current").isNull(), file("processed", unused))
    return files.select(*KEY, old.alias("old"), F.when(F.col("current").isNotNull(), file("current", F.array())).alias("new"))


def diff(files: DataFrame) -> DataFrame:
    """(cube_id, label, change, granule_id): what the next run has to process.

    ``added``: only inserted, not in the processed version or deleted from it;
    ``replaced``: inserted and deleted, there with another checksum; ``removed``:
    only deleted, used by the last run and without a file now (granule_id is
    null).  A null checksum equals only a null checksum.
    """
    d = with_deltas(files)
    into, out_of = (F.exists("deltas", lambda x: x["op"] == op) for op in ("insert", "delete"))  # noqa: B023
    change = F.when(into & out_of, "replaced").when(into, "added").when(out_of, "removed")
    return d.select(*KEY, change.alias("change"), F.col("new.granule_id").alias("granule_id")).where("change is not null")


def pending(granules: DataFrame, run_log: DataFrame) -> DataFrame:
    return diff(manifests(granules, run_log))


# ---- commits


class CommitLog:
    """Outputs whose commit also holds the processed version.

    A run writes its data under a name of its own and then creates
    ``_commits/N.json`` (through a temporary file and a rename that fails if N
    exists).  Readers see only data that a commit names, so a failed run leaves
    nothing behind that is read, and the next one starts from the last commit.

    Two runs can't commit the same N where a rename refuses an existing target in
    one step, as HDFS does.  On a local file system and on object stores the
    test and the rename are two steps: there, let one run write at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _read(self, p) -> str:
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        found = [(int(m[1]), s.getPath()) for s in self._fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))]
        return [json.loads(self._read(p)) for _, p in sorted(found, key=lambda x: x[0])]

    def processed_version(self):
        done = self.commits()
        return done[-1]["version"] if done else None

    def write(self, df: DataFrame, version, manifest: DataFrame | None = None, base: int | None = None, **more) -> bool:
        """Write and commit; False (and nothing visible) if ``version`` is committed already.

        ``manifest`` (what the run has used) is written beside the data and named
        by the same commit, as are the values of ``more``.  ``base`` is the number
        of commits that ``df`` was made from; any other number is an error.
        """
        done = self.commits()
        if any(c["version"] == version for c in done):
            return False
        n = len(done)
        if base is not None and n != base:
            raise RuntimeError("another run has committed meanwhile")
        name = f"{n:08d}-{self._jvm.java.util.UUID.randomUUID()}"
        data = f"{self.path}/data-{name}"
        df.write.parquet(data)
        if manifest is not None:
            manifest.write.parquet(f"{self.path}/manifest-{name}")
            more["manifest"] = f"manifest-{name}"
        self._fs.mkdirs(self._path(f"{self.path}/_commits"))
        temp, final = self._path(f"{data}.json"), self._path(f"{self.path}/_commits/{n:08d}.json")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": version, "data": data.rsplit("/", 1)[1]} | more).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError("another run has committed meanwhile")
        return True

    def unpublished(self) -> list[tuple[int, dict]]:
        """Numbered commits that ``mark_published`` was not called for, oldest first."""
        there = lambda n: self._fs.exists(self._path(f"{self.path}/_published/{n:08d}"))
        return [(n, c) for n, c in enumerate(self.commits()) if not there(n)]

    def mark_published(self, n: int) -> None:
        self._fs.create(self._path(f"{self.path}/_published/{n:08d}"), True).close()

    def read(self) -> DataFrame | None:
        done = self.commits()
        return self.spark.read.parquet(*[f"{self.path}/{c['data']}" for c in done]) if done else None
