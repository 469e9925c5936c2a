"""Generations of tables in a folder: readers see the one that the manifest names, and a new one appears as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(Exception):
    """Someone else published meanwhile."""


class Snapshots:
    """folder: on any file system that Spark writes; creating a file must fail where it is there, which is what lets one of two publishers win."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(conf)

    def revision(self) -> int:
        """The published revision; 0 if there is none."""
        where = self.path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, revision: int | None = None) -> dict:
        revision = self.revision() if revision is None else revision
        if not revision:
            return {"revision": 0, "content_revision": 0, "generation": 0, "tables": {}, "schemas": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{revision}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str) -> DataFrame:
        now = self.manifest()
        return self._at(now, table, None)

    def slots(self, table: str, slots: set[int]) -> DataFrame:
        """Some slots of a table in slots, as read gives the whole."""
        return self._at(self.manifest(), table, slots)

    def folders(self, table: str, key: str, values: list) -> DataFrame:
        """The rows of some folders of a table whose folders are named by one column; no other folder is listed."""
        now = self.manifest()
        schema, at = T.StructType.fromJson(now["schemas"][table]), f"{self.folder}/{now['tables'][table]}"
        paths = [f"{at}/{key}={value}" for value in values]
        return self.spark.read.schema(schema).option("basePath", at).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _at(self, now: dict, table: str, slots: set[int] | None) -> DataFrame:
        schema, at = T.StructType.fromJson(now["schemas"][table]), now["tables"][table]
        if isinstance(at, str):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}")
        paths = [f"{self.folder}/{folder}" for slot, folder in at.items() if slots is None or int(slot) in slots]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], expected: int, full: bool = True, sort: dict[str, list[str]] | None = None, by: dict[str, list[str]] | None = None, touched: dict[str, set[int]] | None = None, notes: dict | None = None) -> int:
        """Writes the tables and makes them current if `expected` still is; else raises Conflict. full: a whole scan, which moves the generation; else only the content revision moves.

        Tables that are not given stay. sort: columns that a table's files are ordered by, so that scans skip row groups. by: columns
        that a table's folders are named by, so that scans skip files. touched: of tables in slots (by their column `slot`,
        which isn't read back) those slots that the rows replace; the files of all others stay as they are and are not read.
        notes: what else the manifest is to hold.
        """
        old = self.manifest()
        if old["revision"] != expected:
            raise Conflict(f"revision is {old['revision']}, not {expected}")
        new = {"revision": expected + 1, "content_revision": old["content_revision"] + 1, "generation": old["generation"] + full, "tables": dict(old["tables"]), "schemas": dict(old["schemas"]), "notes": old.get("notes", {}) | (notes or {})}
        for name, df in tables.items():
            at = f"{name}-{uuid.uuid4().hex}"
            if keys := (sort or {}).get(name):
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            if touched is not None and name in touched:
                df.write.partitionBy("slot").parquet(f"{self.folder}/{at}")
                found = {s.getPath().getName().removeprefix("slot=") for s in self.fs.listStatus(self.path(f"{self.folder}/{at}")) if s.isDirectory()}
                kept = {s: f for s, f in (old["tables"].get(name) or {}).items() if int(s) not in touched[name]}
                new["tables"][name], new["schemas"][name] = kept | {s: f"{at}/slot={s}" for s in found}, df.drop("slot").schema.jsonValue()
                continue
            df.write.partitionBy(*(by or {}).get(name, [])).parquet(f"{self.folder}/{at}")
            new["tables"][name], new["schemas"][name] = at, df.schema.jsonValue()  # a table without rows has no file to tell its schema
        self._put(new)
        return new["revision"]

    def _put(self, manifest: dict) -> None:
        target = self.path(f"{self.folder}/manifests/{manifest['revision']}.json")
        try:
            out = self.fs.create(target, False)
        except Exception as e:
            raise Conflict(f"revision {manifest['revision']} is taken") from e
        out.writeBytes(json.dumps(manifest))  # ASCII
        out.close()
