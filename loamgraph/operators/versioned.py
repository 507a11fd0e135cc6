"""Immutable table versions and the record deltas between them.

A table is a folder of immutable Parquet data files.  Each commit writes a *manifest* (one line per live file:
path, bucket, row count, digest of the rows, path of its deletion vector) and then one small JSON commit file,
created exclusively, that names the manifest and carries free metadata.  Manifests are read and compared by the driver,
without a job.  Readers see a version only once its
commit file exists, so a job that dies leaves files no version names.

``changes(a, b)`` diffs two manifests: files only in ``b`` are added, files only in ``a`` removed, and a file in
both whose deletion vector grew or shrank yields exactly those rows.  Files with equal bucket, row count and
digest hold the same rows and cancel without being read.  Rows that a rewrite merely carried over cancel too.

``refresh(df)`` makes the table hold ``df``: buckets whose digest an earlier version already had keep that file, only
the others are written; if nothing differs, no version is made.

``run_incremental`` processes such a delta and stores the processed source version in the *same* commit as the
output; a run that fails before the commit is repeated from the old version, one that fails after it is not.

A commit is made by renaming a finished file, which excludes other writers where rename is exclusive (HDFS, local
disks); on an object store without that, a table may have one writer at a time.  File names and deletion vectors'
folders are planned by the driver, as for any scan; rows are not.

Defined results: null keys go to one bucket and compare equal; repeated rows count with multiplicity; an empty
table commits an empty manifest; columns may have any name except the prefix ``_vt_``.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

class DataFile(NamedTuple):
    """A live file of a version."""

    file: str
    bucket: int
    rows: int
    digest_a: int
    digest_b: int
    dv: str | None = None

    @property
    def content(self) -> tuple:
        """Equal for files that hold the same rows."""
        return self.bucket, self.rows, self.digest_a, self.digest_b


class CommitConflict(RuntimeError):
    """Another writer has made the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int | None = None):
        """buckets: files of an overwrite; by default the session's shuffle partitions."""
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        now = self.latest() if buckets is None else -1
        held = self.commit_info(now).get("buckets") if now >= 0 else None
        self.buckets = buckets or held or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- commits ---------------------------------------------------------------------------------------------
    def _commit_path(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    def latest(self) -> int:
        """The newest version, -1 if there is none."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "_"), default=-1)

    def commit_info(self, version: int) -> dict:
        return json.loads(self._read(self._commit_path(version)).decode())

    def _commit(self, version: int, manifest: str, meta: dict) -> int:
        body = json.dumps({"version": version, "manifest": manifest, "buckets": self.buckets, "meta": meta}).encode()
        part = self._path(f"{self.root}/commits/_{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(body))
        out.close()
        target = self._path(self._commit_path(version))
        # rename of a finished file: the commit appears whole or not at all, and only where no other exists
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise CommitConflict(f"version {version} of {self.root} exists")
        return version

    def _read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _write_manifest(self, files: list[DataFile]) -> str:
        path = f"{self.root}/manifests/{uuid.uuid4().hex}.json.gz"
        out = self._fs.create(self._path(path), False)
        out.write(bytearray(gzip.compress("\n".join(json.dumps(f) for f in files).encode())))
        out.close()
        return path

    def manifest(self, version: int) -> list[DataFile]:
        """The files of a version: names and five numbers each, which the driver plans reading by, as for any scan."""
        if version < 0:
            return []
        body = gzip.decompress(self._read(self.commit_info(version)["manifest"])).decode()
        return [DataFile(*json.loads(line)) for line in body.split("\n") if line]

    # -- writing ---------------------------------------------------------------------------------------------
    def bucket_of(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _digest(columns: list[str]) -> list[Column]:
        cols = [F.col(f"`{c}`") for c in columns]
        # sums, not xor: a repeated row must not cancel itself; the top 36 bits, so that 2^27 rows fit a long
        a, b = F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)
        return [F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright(a, 28)).alias("digest_a"), F.sum(F.shiftright(b, 28)).alias("digest_b")]

    def _write(self, df: DataFrame) -> list[DataFile]:
        """Write the rows, one file for each bucket that has any; the new files."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        bucketed = df.withColumn("_vt_bucket", self.bucket_of(*self.key))
        bucketed.repartition(self.buckets, "_vt_bucket").write.partitionBy("_vt_bucket").parquet(path)
        if not self._fs.globStatus(self._path(f"{path}/_vt_bucket=*/*.parquet")):  # no rows, no files
            return []
        back = self.spark.read.schema(bucketed.schema).option("basePath", path).parquet(path)
        row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_vt_bucket").alias("bucket"))
        made = back.select(row.alias("f"), *[F.col(f"`{c}`") for c in df.columns]).groupBy("f").agg(*self._digest(df.columns)).select("f.file", "f.bucket", "rows", "digest_a", "digest_b")
        return [DataFile(*r) for r in made.collect()]

    def overwrite(self, df: DataFrame, meta: dict | None = None) -> int:
        version = self.latest() + 1
        return self._commit(version, self._write_manifest(self._write(df)), {"op": "overwrite", **(meta or {})})

    def append(self, df: DataFrame, meta: dict | None = None) -> int:
        now = self.latest()
        return self._commit(now + 1, self._write_manifest(self.manifest(now) + self._write(df)), {"op": "append", **(meta or {})})

    def refresh(self, df: DataFrame, meta: dict | None = None, back: int = 16) -> int:
        """The version that holds exactly ``df``: an old one of the last ``back``, or a new one for which only those
        buckets are written that none of these had with the same rows."""
        now = self.latest()
        if now < 0:
            return self.overwrite(df, meta)
        known: dict[tuple, DataFile] = {}
        held: dict[frozenset, int] = {}
        for v in range(now, max(-1, now - back), -1):
            files = self.manifest(v)
            held.setdefault(frozenset((f.file, f.dv) for f in files), v)
            for f in files:
                if f.dv is None:
                    known.setdefault(f.content, f)
        wanted = [tuple(r) for r in df.withColumn("_vt_bucket", self.bucket_of(*self.key)).groupBy("_vt_bucket").agg(*self._digest(df.columns)).collect()]
        keep = [known[w] for w in wanted if w in known]
        fresh = [w[0] for w in wanted if w not in known]
        if not fresh:
            same = held.get(frozenset((f.file, None) for f in keep))
            if same is not None:
                return same
        else:
            keep += self._write(df.filter(self.bucket_of(*self.key).isin(fresh)) if keep else df)
        return self._commit(now + 1, self._write_manifest(keep), {"op": "refresh", **(meta or {})})

    def replace_buckets(self, df: DataFrame, buckets: list[int] | None, meta: dict | None = None) -> int:
        """Put ``df`` in place of all rows of the given buckets (None: of all)."""
        now = self.latest()
        gone = None if buckets is None else set(buckets)
        kept = [f for f in self.manifest(now) if gone is not None and f.bucket not in gone]
        return self._commit(now + 1, self._write_manifest(kept + self._write(df)), {"op": "replace", **(meta or {})})

    def _mark(self, files: list[DataFile], keys: DataFrame, on: list[str] | None = None) -> list[DataFile]:
        """The files with every row deleted that has one of the keys; no data file is rewritten."""
        on = on or self.key
        if not files:
            return files
        dv = f"{self.root}/dv/{uuid.uuid4().hex}"
        named = keys.select([F.col(f"`{c}`").alias(f"_vt_k{i}") for i, c in enumerate(keys.columns)]).distinct()
        hit = self._rows(files, positions=True).join(named, [F.col(f"`{k}`").eqNullSafe(F.col(f"_vt_k{i}")) for i, k in enumerate(on)], "left_semi")
        hit.select("_vt_file", "_vt_pos").unionByName(self._dead(files)).distinct().write.parquet(dv)
        touched = {r[0] for r in self.spark.read.schema("_vt_file string, _vt_pos long").parquet(dv).select("_vt_file").distinct().collect()}
        return [f._replace(dv=dv) if f.file in touched else f for f in files]

    def delete(self, keys: DataFrame, meta: dict | None = None) -> int:
        now = self.latest()
        return self._commit(now + 1, self._write_manifest(self._mark(self.manifest(now), keys.select(*self.key))), {"op": "delete", **(meta or {})})

    def upsert(self, df: DataFrame, meta: dict | None = None) -> int:
        """Replace all rows of the keys in ``df`` by its rows, in one commit."""
        now = self.latest()
        return self._commit(now + 1, self._write_manifest(self._mark(self.manifest(now), df.select(*self.key)) + self._write(df)), {"op": "upsert", **(meta or {})})

    # -- reading ---------------------------------------------------------------------------------------------
    def _rows(self, files: list[DataFile], positions: bool = False) -> DataFrame:
        """Live rows of the given files."""
        if not files:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_vt_none", T.StringType())]))
        df = self.spark.read.schema(self.spark.read.parquet(files[0].file).schema).parquet(*[f.file for f in files])
        marked = any(f.dv for f in files)
        if positions or marked:
            df = df.withColumns({"_vt_file": F.col("_metadata.file_path"), "_vt_pos": F.col("_metadata.row_index").cast("long")})
            if marked:
                df = df.join(self._dead(files), ["_vt_file", "_vt_pos"], "left_anti")
            if not positions:
                df = df.drop("_vt_file", "_vt_pos")
        return df

    def _dead(self, files: list[DataFile]) -> DataFrame:
        """(file, position) of every deleted row of the given files."""
        schema = "_vt_file string, _vt_pos long"
        marked = [f for f in files if f.dv]
        if not marked:
            return self.spark.createDataFrame([], schema)
        # a path may come back with another spelling of the scheme (file:/ and file:///): compare the last folder
        live = self.spark.createDataFrame([(f.file, f.dv.rpartition("/")[2]) for f in marked], "_vt_file string, of string")
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        all_dv = self.spark.read.schema(schema).parquet(*sorted({f.dv for f in marked})).withColumn("of", folder)
        return all_dv.join(live, ["_vt_file", "of"]).select("_vt_file", "_vt_pos").distinct()

    def snapshot(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(self.latest() if version is None else version))

    def files_changed(self, start: int, end: int) -> list[int]:
        """The buckets that don't have the same files and deletion vectors in both versions; only manifests are read."""
        old, new = ({(f.bucket, f.file, f.dv) for f in self.manifest(v)} for v in (start, end))
        return sorted({b for b, _, _ in old ^ new})

    def changes(self, start: int, end: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Net record delta from version ``start`` (-1: before the first) to ``end``, of all buckets or the given ones.

        The table's columns, ``_vt_change`` (insert or delete) and ``_vt_count``.
        """
        old, new = self.manifest(start), self.manifest(self.latest() if end is None else end)
        if buckets is not None:
            some = set(buckets)
            old, new = ([f for f in m if f.bucket in some] for m in (old, new))
        was, now = {f.file: f for f in old}, {f.file: f for f in new}
        came, went = [f for f in new if f.file not in was], [f for f in old if f.file not in now]
        # a file that came cancels one equal file that went, one for one
        spare = Counter(f.content for f in went if f.dv is None) & Counter(f.content for f in came if f.dv is None)

        def without(files: list[DataFile]) -> list[DataFile]:
            left, out = Counter(spare), []
            for f in files:
                if f.dv is None and left[f.content] > 0:
                    left[f.content] -= 1
                else:
                    out.append(f)
            return out

        added, removed = without(came), without(went)
        parts = [(self._rows(added), 1), (self._rows(removed), -1)]
        kept = [f for f in new if f.file in was and was[f.file].dv != f.dv]
        if kept:
            dead_new, dead_old = self._dead(kept), self._dead([was[f.file] for f in kept])
            rows = self._rows([f._replace(dv=None) for f in kept], positions=True)
            at = ["_vt_file", "_vt_pos"]
            for marked, sign in ((dead_new.join(dead_old, at, "left_anti"), -1), (dead_old.join(dead_new, at, "left_anti"), 1)):
                parts.append((rows.join(marked, at, "left_semi").drop(*at), sign))
        signed = [p.withColumn("_vt_sign", F.lit(s)) for p, s in parts if p.columns != ["_vt_none"]]
        if not signed:
            return self.spark.createDataFrame([], "_vt_change string, _vt_count long")
        rows = signed[0]
        for p in signed[1:]:
            rows = rows.unionByName(p)
        cols = [c for c in rows.columns if c != "_vt_sign"]
        net = rows.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum("_vt_sign").alias("_vt_n")).filter("_vt_n <> 0")
        return net.select(
            *[F.col(f"`{c}`") for c in cols],
            F.when(F.col("_vt_n") > 0, "insert").otherwise("delete").alias("_vt_change"),
            F.abs("_vt_n").alias("_vt_count"),
        )


def run_incremental(source: VersionedTable, sink: VersionedTable, work: Callable[[DataFrame], DataFrame], holds: list[str] | None = None) -> int | None:
    """Process what changed in ``source`` since the version stored in ``sink``'s last commit.

    ``work`` gets all rows that the touched keys have now, as its output replaces the sink's rows of these keys;
    ``holds`` names the sink's columns that hold the source's key (by default those of the same names, which its output
    must have).  The processed version is part of that commit.
    None if nothing is new.  A failure at any point leaves the old pair of (output, processed version).
    """
    done, now = sink.latest(), source.latest()
    seen = sink.commit_info(done)["meta"].get("source_version", -1) if done >= 0 else -1
    if seen == now:
        return None
    delta = source.changes(seen, now)
    files = sink.manifest(done)
    if "_vt_none" in delta.columns or len(delta.columns) == 2:
        return sink._commit(done + 1, sink._write_manifest(files), {"op": "empty", "source_version": now})
    keys = delta.select(*source.key).distinct()
    rows = source.snapshot(now)
    if set(source.key) <= set(rows.columns):
        named = keys.select([F.col(k).alias(f"_vt_k{i}") for i, k in enumerate(source.key)])
        rows = rows.join(named, [F.col(k).eqNullSafe(F.col(f"_vt_k{i}")) for i, k in enumerate(source.key)], "left_semi")
    else:  # no file is left
        rows = delta.drop("_vt_change", "_vt_count").limit(0)
    out = work(rows)
    holds = holds or source.key
    if missing := set(holds) - set(out.columns):
        raise ValueError(f"the output has no column {sorted(missing)}: name those that hold the source's key, so that changed records can be replaced")
    fresh = sink._write(out)
    return sink._commit(done + 1, sink._write_manifest(sink._mark(files, keys, holds) + fresh), {"op": "incremental", "source_version": now})
