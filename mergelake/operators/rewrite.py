"""A table of files by path that is rewritten in versions: upserts with the content after, what was before from the version before, a manifest that is written last, and undo.

The base and every change are folders of their own, written whole before a manifest names them.  A manifest is a small file with a number; the highest one counts, so a job that
fails before its manifest leaves the table as it was, and readers of an older version go on with its folders.  Undo writes a manifest without the last change.  Reading
takes each path from the last change that has it, and from the base where none has: only the changes' paths are compared, not the base's content.

Edge cases: of several rows of one change with the same path the caller must choose one (an error); a null content deletes the path; changes without rows make a version too; undo with no change left is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import store

CHANGE = "path string, after string"


class Files:
    """Files of a table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        from pyarrow import fs

        where, root = store(self.root)
        if where.get_file_info(f"{root}/manifests").type == fs.FileType.NotFound:
            return []
        return sorted(int(f.base_name) for f in where.get_file_info(fs.FileSelector(f"{root}/manifests")) if f.base_name.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        where, root = store(self.root)
        version = self.versions()[-1] if version is None else version
        with where.open_input_stream(f"{root}/manifests/{version:09}") as f:
            return json.loads(f.read()) | {"version": version}

    def _switch(self, manifest: dict) -> int:
        """A new manifest, written aside and moved to its name when it is whole."""
        where, root = store(self.root)
        version = max(self.versions(), default=0) + 1
        where.create_dir(f"{root}/manifests", recursive=True)
        aside = f"{root}/manifests/_{uuid.uuid4().hex}"
        with where.open_output_stream(aside) as f:
            f.write(json.dumps(manifest).encode())
        where.move(aside, f"{root}/manifests/{version:09}")
        return version

    def create(self, files: DataFrame) -> int:
        """Files (path, content) as the table's base."""
        folder = f"base-{uuid.uuid4().hex}"
        files.select("path", "content").write.parquet(f"{self.root}/{folder}")
        return self._switch({"base": folder, "changes": []})

    def read(self, version: int | None = None, of: Callable[[Column], Column] = lambda content: content) -> DataFrame:
        """(path, content) of a version, the last one unless said; ``of`` is what is wanted of a content, such as a digest, and is made before files are compared, so that no content is shuffled for it."""
        return self._files(self.manifest(version), of)

    def _files(self, m: dict, of: Callable[[Column], Column] = lambda content: content) -> DataFrame:
        base = self.spark.read.schema("path string, content string").parquet(f"{self.root}/{m['base']}").select("path", of(F.col("content")).alias("content"))
        if not m["changes"]:
            return base
        changed = self._changes(m)
        last = changed.groupBy("path").agg(F.max("turn").alias("turn"))
        # What the last change has is current; of those before it only rows that no later one has.
        rows = changed.select("path", "turn", F.col("after").isNotNull().alias("there"), of(F.col("after")).alias("content"))
        final = len(m["changes"]) - 1
        new = rows.filter(F.col("turn") == final).unionByName(rows.filter(F.col("turn") < final).join(last, ["path", "turn"], "left_semi")) if final else rows
        return base.join(last, "path", "left_anti").union(new.filter("there").select("path", "content"))

    def _changes(self, m: dict) -> DataFrame:
        one = lambda k, folder: self.spark.read.schema(CHANGE).parquet(f"{self.root}/{folder}").withColumn("turn", F.lit(k))
        return reduce(DataFrame.union, [one(k, folder) for k, folder in enumerate(m["changes"])])

    def upsert(self, changes: DataFrame) -> int:
        """A new version with changes (path, content).  What was there before stays in the folders of the version before, so it is not written again; paths are checked as written, without the contents, before the manifest."""
        m, folder = self.manifest(), f"change-{uuid.uuid4().hex}"
        changes.select("path", F.col("content").alias("after")).write.parquet(f"{self.root}/{folder}")
        again = self.spark.read.schema(CHANGE).parquet(f"{self.root}/{folder}").groupBy("path").count().filter("count > 1").select("path").first()
        if again:
            raise ValueError(f"several contents for {again[0]}")
        return self._switch({"base": m["base"], "changes": [*m["changes"], folder]})

    def undo(self) -> int:
        """A new version without the last change."""
        m = self.manifest()
        if not m["changes"]:
            raise ValueError("there is no change to undo")
        return self._switch({"base": m["base"], "changes": m["changes"][:-1]})

    def last_change(self) -> DataFrame:
        """(path, before, after) of the last change; before is what the version without it has."""
        m = self.manifest()
        before = self._files(m | {"changes": m["changes"][:-1]}).withColumnRenamed("content", "before")
        return self._change(m).join(before, "path", "left").select("path", "before", "after")

    def changed_paths(self) -> DataFrame:
        """(path) of the last change."""
        return self._change(self.manifest()).select("path")

    def _change(self, m: dict) -> DataFrame:
        return self.spark.read.schema(CHANGE).parquet(f"{self.root}/{m['changes'][-1]}")

    def compact(self) -> int:
        """The same files as a base of their own; older versions stay readable, and undo begins anew."""
        return self.create(self.read())
