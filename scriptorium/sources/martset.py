"""A set of tables refreshed as one commit.

The original truncates eight tables in one transaction and fills them in three
more, so a failure in between leaves readers with empty or half-filled tables. Here a
refresh writes every table to a new folder first and then publishes all of them
at once: a manifest file, numbered one above the last, names the folders or files of each
table. Readers resolve a manifest first and read only what it names; a failure at any
point before leaves them on the old set.

A commit states the manifest it started from. The manifest is put in place by a rename
that never overwrites, so of two writers from one manifest the later one gets
``Conflict``. Old manifests and what only they name go with ``vacuum``.

Layout of ``root``: ``_manifests/<number>.json`` and ``data/<commit>/<table>``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

NO_MANIFEST = 0


class Conflict(RuntimeError):
    """Another commit came first."""


class MartSet:
    """Tables under one folder of any store that Spark reads. ``root`` names the store by its scheme."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------- the store

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _listed(self, folder: str) -> list:
        fs, path = self._fs(), self._path(folder)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _put(self, text: str, name: str) -> None:
        """Writes a small file beside its place and renames it there, unless something is there."""
        fs, folder = self._fs(), name.rsplit("/", 1)[0]
        staged, place = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(name)
        fs.mkdirs(self._path(folder))
        out = fs.create(staged)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self.spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename").valueOf("NONE")
        if fs.exists(place):
            fs.delete(staged, False)
            raise Conflict(name)
        context = self._hadoop.FileContext.getFileContext(place.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(
            getattr(self.spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = rename
        try:
            context.rename(staged, place, options)
        except Exception as e:  # the store's own exception says that the place is taken
            fs.delete(staged, False)
            if fs.exists(place):
                raise Conflict(name) from e
            raise

    # ----------------------------------------------------------------- reads

    def numbers(self) -> list[int]:
        """Numbers of the commits that can be read, ascending."""
        names = [s.getPath().getName() for s in self._listed(f"{self.root}/_manifests")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> int:
        return max(self.numbers(), default=NO_MANIFEST)

    def manifest(self, number: int | None = None) -> dict[str, dict]:
        """Table -> its entry in a commit (the last one unless told)."""
        number = self.latest() if number is None else number
        if number == NO_MANIFEST:
            return {}
        rows = self.spark.read.text(f"{self.root}/_manifests/{number:012d}.json", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as of a commit. All reads of one report should name one number."""
        entry = self.manifest(number).get(table)
        if entry is None:
            raise KeyError(f"no table {table} in {self.root}")
        return self.open(entry)

    def open(self, entry: dict) -> DataFrame:
        if "files" in entry:  # file by file: the list is a table itself
            files = [r["file"] for r in self.spark.read.parquet(entry["files"]).select("file").collect()]
            return self.spark.read.schema(entry["schema"]).parquet(*files) if files else self.spark.createDataFrame([], entry["schema"])
        return self.spark.read.parquet(*entry["folders"])

    # ---------------------------------------------------------------- writes

    def new_folder(self, table: str) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}/{table}"

    def write(self, df: DataFrame, table: str) -> dict:
        """Rows of a table to come: written, not published. Returns its entry."""
        folder = self.new_folder(table)
        df.write.parquet(folder)
        return {"folders": [folder]}

    def publish(self, entries: Mapping[str, dict], start: int) -> int:
        """Makes ``entries`` the set, all at once. ``start``: the commit they were made from."""
        if self.latest() != start:
            raise Conflict(f"commit {self.latest()} came after {start}")
        self._put(json.dumps(dict(entries), sort_keys=True), f"{self.root}/_manifests/{start + 1:012d}.json")
        return start + 1

    def refresh(self, tables: Mapping[str, DataFrame], keep_others: bool = False, start: int | None = None) -> int:
        """Writes the tables and publishes them as one commit, in place of the whole set, or
        beside its other tables. Returns the commit's number."""
        start = self.latest() if start is None else start
        entries = self.manifest(start) if keep_others else {}
        return self.publish({**entries, **{name: self.write(df, name) for name, df in tables.items()}}, start)

    def append(self, rows: Mapping[str, DataFrame], start: int | None = None) -> int:
        """Adds rows to tables as one commit; what is there isn't read or written."""
        start = self.latest() if start is None else start
        entries = self.manifest(start)
        return self.publish({**entries, **{name: self.longer(entries, name, df) for name, df in rows.items()}}, start)

    def longer(self, entries: Mapping[str, dict], table: str, rows: DataFrame) -> dict:
        """The entry of a table with rows added; they are written, nothing is published."""
        return {"folders": entries.get(table, {"folders": []})["folders"] + self.write(rows, table)["folders"]}

    def vacuum(self, keep: int = 2, min_age_s: float = 86_400) -> list[str]:
        """Deletes all but the last ``keep`` manifests, and the folders of commits that no
        manifest left names, unless they are younger than ``min_age_s``: these may
        belong to a commit under way. Returns the deleted folders."""
        fs, numbers = self._fs(), self.numbers()
        for number in numbers[:-keep]:
            fs.delete(self._path(f"{self.root}/_manifests/{number:012d}.json"), False)
        used = json.dumps([self.manifest(n) for n in numbers[-keep:]])
        for n in numbers[-keep:]:
            for entry in self.manifest(n).values():
                if "files" in entry:
                    used += "".join(r["file"] for r in self.spark.read.parquet(entry["files"]).select("file").collect())
        gone = []
        for status in self._listed(f"{self.root}/data"):
            name = status.getPath().getName()
            if name not in used and time.time() - status.getModificationTime() / 1000 >= min_age_s:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return gone
