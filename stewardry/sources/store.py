"""Versioned, bucketed Parquet tables.

Rows lie in buckets by the hash of their key. A change touches only the buckets of
its rows: additions are written as further parts, anything else rewrites the bucket.
A new manifest, named by its number and never overwritten, makes all of a change
visible at once; of two writers that started from the same one the second fails.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stewardry.plans import delta
from stewardry.plans.catalog import Catalog
from stewardry.runtime import cut_bare

#: Rows that a bucket of a bulk load holds, least and most buckets of a table, and parts of a bucket before it is rewritten as one.
BUCKET_ROWS, LEAST, MOST, PARTS = 500_000, 8, 4096, 8


class ConflictError(Exception):
    """Somebody else has committed since this store was read."""


class Store:
    """Tables below ``root`` (any file system Spark can reach), with catalog and manifests as JSON."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.refresh()
        text = self._read("catalog.json")
        self.catalog = Catalog.from_json(text) if text else Catalog()

    def refresh(self) -> None:
        """Reads the newest manifest."""
        self.version = max(self._manifests(), default=0)
        state = json.loads(self._read(f"manifest-{self.version:08d}.json") or "{}")
        #: By table: schema, key, number of buckets, and the folders that hold each bucket's parts.
        self.tables: dict[str, dict] = state.get("tables", {})
        self.counters: dict[str, int] = state.get("counters", {})

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _manifests(self) -> list[int]:
        return [int(m.group(1)) for n in self._names("") if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]

    def _read(self, name: str) -> str | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        """Writes beside and renames, so that readers never see half of it; without ``overwrite`` an existing file is a conflict."""
        fs, new = self._fs(), self._path(f".{name}.{uuid.uuid4()}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf) if new.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            context.rename(new, self._path(name), options)
        except Exception as e:
            fs.delete(new, False)
            if not overwrite and fs.exists(self._path(name)):
                raise ConflictError(f"{name} is there already") from e
            raise

    def save_catalog(self) -> None:
        self._write("catalog.json", self.catalog.to_json(), True)

    def _entry(self, name: str, rows: int = 0) -> dict:
        if name in self.tables:
            return self.tables[name]
        t = self.catalog.table(name)
        return {"schema": t.schema, "key": t.key, "buckets": min(MOST, max(LEAST, rows // BUCKET_ROWS)), "parts": {}}

    def _rows(self, name: str, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        parts = {k: v for k, v in entry["parts"].items() if buckets is None or int(k) in buckets}
        paths = [f"{self.root}/{name}/{v}/bucket_={k}" for k, versions in parts.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], entry["schema"])
        return self.spark.read.schema(entry["schema"]).parquet(*paths)

    def table(self, name: str) -> DataFrame:
        """The current version; an unwritten table is empty."""
        known = name if name in self.tables else self.catalog.table(name).name
        return self._rows(known, self._entry(known))

    def _bucket(self, entry: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{entry['key']}`")), F.lit(entry["buckets"])).cast("int")

    def declare(self, name: str, df: DataFrame, key: str, rows: int = 0) -> None:
        """A table that is not in the catalog, such as the rows of a view."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType(df.schema.fields))
        self.tables[name] = {"schema": schema, "key": key, "buckets": min(MOST, max(LEAST, rows // BUCKET_ROWS)), "parts": {}}

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)

    def commit(self, changes: dict[str, DataFrame], counters: dict[str, int] | None = None, added: set[str] = frozenset(), rows: dict[str, int] | None = None) -> None:
        """Applies weighted rows (``_w``) to tables and makes all of it visible by one new manifest.

        ``added`` names the tables whose changes only add rows; ``rows`` tells how many a
        bulk load brings, which sizes the buckets of a new table.
        """
        new, version = {**self.tables}, self.version + 1
        for name, change in changes.items():
            entry = self._entry(name, (rows or {}).get(name, 0))
            entry = {**entry, "parts": {k: list(v) for k, v in entry["parts"].items()}}
            columns = [c for c in change.columns if c != delta.W]
            folder = f"v{version:08d}-{uuid.uuid4().hex[:8]}"  # of this writer alone, as another one may have the same number
            path = f"{self.root}/{name}/{folder}"
            out = change.select(*columns)
            touched: list[int] = []
            if name not in added:
                change = cut_bare(change)
                touched = sorted(r[0] for r in change.select(self._bucket(entry)).distinct().collect())  # at most a number per bucket
            full = [int(k) for k, v in entry["parts"].items() if len(v) >= PARTS]
            if name not in added:
                out = delta.apply(self._rows(name, entry, touched), change)
            elif full:  # many small parts become one
                touched = full
                out = out.unionByName(self._rows(name, entry, full))
            out.withColumn("bucket_", self._bucket(entry)).repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(path)
            written = {int(n.partition("=")[2]) for n in self._names(f"{name}/{folder}") if n.startswith("bucket_=")}
            for k in touched:
                entry["parts"].pop(str(k), None)
            for k in written:
                entry["parts"].setdefault(str(k), []).append(folder)
            new[name] = entry
        counts = {**self.counters, **(counters or {})}
        self._write(f"manifest-{version:08d}.json", json.dumps({"tables": new, "counters": counts}), False)
        self.tables, self.counters, self.version = new, counts, version

    def vacuum(self) -> None:
        """Removes everything that the newest manifest does not name: what was erased is then in no file."""
        self.refresh()
        fs = self._fs()
        for name, entry in self.tables.items():
            used = {(v, int(k)) for k, versions in entry["parts"].items() for v in versions}
            for folder in self._names(name):
                if not any(u == folder for u, _ in used):
                    fs.delete(self._path(f"{name}/{folder}"), True)
                    continue
                for sub in self._names(f"{name}/{folder}"):
                    if sub.startswith("bucket_=") and (folder, int(sub.partition("=")[2])) not in used:
                        fs.delete(self._path(f"{name}/{folder}/{sub}"), True)
        for v in self._manifests():
            if v < self.version:
                fs.delete(self._path(f"manifest-{v:08d}.json"), False)
