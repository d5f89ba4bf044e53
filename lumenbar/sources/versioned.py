"""A Parquet table of versions: a manifest per version, a rename to make it the current one.

Rows lie in folders that are written once and never changed. A manifest lists, for one
version, the schema, the partition columns and each partition's value and folder; the highest
numbered manifest is the table. A merge reads and rewrites the partitions it touches and
renames its manifest into place as the last step, so whatever fails before leaves the version
before readable, and of two writers that started from one version the second fails.

Partition columns stay in the files with their types, and folders are named by a hash, so a
value never goes through a path: "001" is no number and NULL is a value. Reads take the
schema from the manifest: a column added later is NULL in older folders, and none is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbar.operators.merge import insert_only, one_per_key, update_columns
from lumenbar.session import discard, scratch

PART = "_part"
#: Types that hold every value of the ones before them.
WIDER = (["tinyint", "smallint", "int", "bigint"], ["float", "double"])

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class ConcurrentWrite(RuntimeError):
    """Another writer made this version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: T.StructType
    partition: tuple[str, ...] = ()
    #: hash of the partition's values -> {"folder", "values" (JSON), "rows"}
    parts: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": self.version,
                "schema": json.loads(self.schema.json()),
                "partition": list(self.partition),
                "parts": self.parts,
            }
        )

    @staticmethod
    def from_json(text: str) -> Manifest:
        found = json.loads(text)
        schema = T.StructType.fromJson(found["schema"])
        return Manifest(found["version"], schema, tuple(found["partition"]), found["parts"])


def merged_schema(stored: T.StructType, incoming: T.StructType) -> T.StructType:
    """Stored columns, widened where that loses nothing, then new ones; all may be NULL."""
    known = {f.name: f for f in stored}
    out = []
    for f in stored:
        kind = f.dataType
        if f.name in incoming.names and incoming[f.name].dataType != kind:
            kind = _wider(f.name, kind, incoming[f.name].dataType)
        out.append(T.StructField(f.name, kind, True))
    out += [T.StructField(f.name, f.dataType, True) for f in incoming if f.name not in known]
    return T.StructType(out)


def _wider(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    for order in WIDER:
        if a.simpleString() in order and b.simpleString() in order:
            return max(a, b, key=lambda t: order.index(t.simpleString()))
    raise ValueError(f"column {name}: {a.simpleString()} and {b.simpleString()} do not go together")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types, NULL where ``df`` has none."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def replaced(
    old: DataFrame, new: DataFrame, keys: Sequence[str], newest_by: str | None = None
) -> DataFrame:
    """Replacing upsert in which NULL keys equal each other, so that a rerun adds nothing."""
    new = one_per_key(new, list(keys), newest_by)
    there = new.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return old.join(there, same, "left_anti").unionByName(new)


class VersionedTable:
    """The table at ``path``; all access goes through the session's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self.versions()
        if not versions or (version is not None and version not in versions):
            raise LookupError(f"{self.path} has no version {version or ''}".rstrip())
        path = f"{self.path}/manifests/v{version or versions[-1]:012d}.json"
        stream = self._fs.open(self._at(path))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.from_json(text)

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """All rows of a version, or those of some partitions; the rest is not listed."""
        return self._rows(self.manifest(version), parts)

    def read_partitions(self, where: Column, version: int | None = None) -> DataFrame:
        """Rows of the partitions whose values fulfil ``where``; decided on the manifest."""
        manifest = self.manifest(version)
        found = [r[0] for r in self.partitions(version).where(where).select(PART).collect()]
        return self._rows(manifest, found)

    def partitions(self, version: int | None = None) -> DataFrame:
        """One row per partition: its values with their types, rows, and the hash ``_part``."""
        manifest = self.manifest(version)
        rows = [(k, v["values"], v["rows"]) for k, v in manifest.parts.items()]
        kinds = T.StructType([manifest.schema[c] for c in manifest.partition])
        listed = self.spark.createDataFrame(rows, f"{PART} string, _values string, rows long")
        if not manifest.partition:
            return listed.drop("_values")
        return listed.withColumn("_values", F.from_json("_values", kinds)).select("_values.*", "rows", PART)

    def _rows(self, manifest: Manifest, parts: Sequence[str] | None = None) -> DataFrame:
        chosen = manifest.parts if parts is None else [p for p in parts if p in manifest.parts]
        folders = [f"{self.path}/{manifest.parts[p]['folder']}" for p in chosen]
        if not folders:
            return self.spark.createDataFrame([], manifest.schema)
        rows = self.spark.read.schema(manifest.schema).parquet(*folders)
        return rows.select(*[F.col(f"`{c}`") for c in manifest.schema.names])

    def merge(
        self, incoming: DataFrame, keys: Sequence[str], partition: Sequence[str] = (),
        newest_by: str | None = None,
    ) -> Manifest | None:
        """Incoming rows replace stored rows of their key, NULL being one; columns may be added."""
        return self._combine(
            incoming, keys, partition, lambda old, new: replaced(old, new, keys, newest_by), newest_by
        )

    def insert(self, incoming: DataFrame, keys: Sequence[str], partition: Sequence[str] = ()) -> Manifest | None:
        """Only incoming rows whose key is not stored."""
        return self._combine(incoming, keys, partition, lambda old, new: insert_only(old, new, keys))

    def update(
        self, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str],
        partition: Sequence[str] = (), newest_by: str | None = None,
    ) -> Manifest | None:
        """Incoming rows overwrite ``columns`` of stored rows; unknown keys are added whole."""
        return self._combine(
            incoming, keys, partition,
            lambda old, new: update_columns(old, new, keys, columns, newest_by), newest_by,
        )

    def _combine(
        self, incoming: DataFrame, keys: Sequence[str], partition: Sequence[str],
        combine: Combine, newest_by: str | None = None,
    ) -> Manifest | None:
        """The new version, or the current one if nothing came in.

        A row's partition must follow from its key, so the partition columns are keys.
        """
        before = self.manifest() if self.exists() else None
        if before:
            partition = before.partition
        if not set(partition) <= set(keys):
            raise ValueError("the partition columns must be among the keys")
        given = incoming.schema
        schema = merged_schema(before.schema if before else T.StructType([]), given)
        values = F.to_json(F.struct(*[F.col(f"`{c}`") for c in partition])) if partition else F.lit("{}")
        with scratch(self.spark) as held:
            new = held.store(conform(incoming, schema).withColumn(PART, F.md5(values)))
            # one row a partition that the batch touches: days, not rows
            touched = {r[0]: r[1] for r in new.select(PART, values.alias("v")).distinct().collect()}
            if not touched:
                return before
            new = new.drop(PART)
            old = [p for p in touched if before and p in before.parts]
            if old:
                merged = combine(conform(self._rows(before, old), schema), new)
            else:
                merged = one_per_key(new, keys, newest_by)
            folder = f"data/{uuid.uuid4().hex}"
            conform(merged, schema).withColumn(PART, F.md5(values)).repartition(PART).write.partitionBy(
                PART
            ).parquet(f"{self.path}/{folder}")
            written = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(PART).count()
            counts = {r[0]: r[1] for r in written.collect()}
        parts = dict(before.parts) if before else {}
        for part, rows in counts.items():
            parts[part] = {"folder": f"{folder}/{PART}={part}", "values": touched[part], "rows": rows}
        version = before.version + 1 if before else 1
        made = Manifest(version, schema, tuple(partition), parts)
        try:
            self._publish(made)
        except BaseException:
            discard(self.spark, f"{self.path}/{folder}")
            raise
        return made

    def _publish(self, manifest: Manifest) -> None:
        """Write the manifest under a name of its own, then rename it without overwriting."""
        jvm = self.spark._jvm
        folder = f"{self.path}/manifests"
        self._fs.mkdirs(self._at(folder))
        draft = self._at(f"{folder}/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(manifest.to_json().encode()))
        finally:
            stream.close()
        name = self._at(f"{folder}/v{manifest.version:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        flags = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, name, flags)
        except Exception as failure:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(failure):
                raise ConcurrentWrite(f"version {manifest.version} of {self.path} exists") from failure
            raise

    def vacuum(self, keep: int = 2) -> list[int]:
        """Drop all but the last ``keep`` versions and the folders only they used.

        Folders of a writer that has not published are not in any manifest; run this when
        none is at work.
        """
        versions = self.versions()
        gone, kept = versions[: -keep or None], versions[-keep:]
        used = {p["folder"] for v in kept for p in self.manifest(v).parts.values()}
        for v in gone:
            self._fs.delete(self._at(f"{self.path}/manifests/v{v:012d}.json"), False)
        if self._fs.exists(self._at(f"{self.path}/data")):
            for write in self._fs.listStatus(self._at(f"{self.path}/data")):
                name = f"data/{write.getPath().getName()}"
                for part in self._fs.listStatus(write.getPath()):
                    if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in used:
                        self._fs.delete(part.getPath(), True)
                if not any(u.startswith(f"{name}/") for u in used):
                    self._fs.delete(write.getPath(), True)
        return gone

    def rollback(self, version: int) -> Manifest:
        """A new version with the content of an earlier one."""
        made = replace(self.manifest(version), version=self.versions()[-1] + 1)
        self._publish(made)
        return made
