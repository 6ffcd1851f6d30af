"""The dataset store (S3, S4): versioned datasets, profiles and the fingerprint registry under one shared root.

``<root>/<name>/`` holds one folder a version and a small pointer file that names the current data and profile
folders.  A save writes a new folder, then replaces the pointer by one rename: readers see the old version or
the new, and a save that dies half-way changes nothing.  The version before the current one stays for readers
that have it open; older ones are removed.  On a cluster the root is a shared folder (HDFS, object store with
an atomic put).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"
REGISTRY = "_registry"
# P7-P9 stored beside the profiles: one table a kind, partitioned by dataset and column
DISTRIBUTIONS = {
    "histogram": "bin int, bin_lo double, bin_hi double, cnt bigint",
    "box": "n bigint, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, n_outliers bigint",
    "counts": "val string, cnt bigint, share double",
}


class Workspace:
    """Named datasets and their profiles under one (shared) root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # file system through Hadoop, so that any cluster file system works
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.exists(p))

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        if fs.exists(p):
            fs.delete(p, True)

    # ---- the pointer
    def _state(self, name: str) -> dict:
        """What the pointer says: folders of data and profile, and those of the version before."""
        path = f"{self.root}/{name}/{POINTER}"
        if not self._exists(path):
            return {}
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, name: str, state: dict) -> None:
        """Replace the pointer in one step, then remove folders that neither version names."""
        jvm, home = self.spark._jvm, f"{self.root}/{name}"
        tmp, target = f"{home}/_next-{uuid.uuid4().hex}", f"{home}/{POINTER}"
        fs, p = self._fs(tmp)
        out = fs.create(p, True)
        out.write(json.dumps(state).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = fs.makeQualified(p)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
            qualified, fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), options)
        known = {state.get(k) for k in ("data", "profile", "old_data", "old_profile")}
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(home)):
            folder = s.getPath().getName()
            if s.isDirectory() and folder.split("-")[0] in ("data", "profile") and folder not in known:
                fs.delete(s.getPath(), True)

    def _commit(self, name: str, kind: str, df: DataFrame) -> dict:
        """Write ``df`` as a new folder and return the pointer that names it."""
        state = self._state(name)
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}/{folder}")
        return {**state, "old_" + kind: state.get(kind), kind: folder}

    # ---- paths and names
    def data_path(self, name: str) -> str | None:
        """Folder of the current data; none for an unknown dataset."""
        folder = self._state(name).get("data")
        return f"{self.root}/{name}/{folder}" if folder else None

    def profile_path(self, name: str) -> str | None:
        folder = self._state(name).get("profile")
        return f"{self.root}/{name}/{folder}" if folder else None

    def exists(self, name: str) -> bool:
        return self.data_path(name) is not None

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(n for n in found if not n.startswith("_") and self.exists(n))

    # ---- S3 / S4
    def save(self, df: DataFrame, name: str, keep_profile: bool = False) -> DataFrame:
        """Write the dataset; its old profile becomes stale and is dropped in the same step."""
        if not name:
            return df
        state = self._commit(name, "data", df)
        if not keep_profile:
            state["old_profile"], state["profile"] = state.get("profile"), None
        self._switch(name, state)
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        path = self.data_path(name)
        if path is None:
            raise KeyError(f"no dataset named {name!r}")
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def save_profile(self, prof: DataFrame, name: str) -> DataFrame:
        self._switch(name, self._commit(name, "profile", prof))
        return self.load_profile(name)

    def load_profile(self, name: str) -> DataFrame | None:
        path = self.profile_path(name)
        return self.spark.read.parquet(path) if path else None

    def registry(self) -> DataFrame:
        from cohortlab.sources.datasets import REGISTRY_SCHEMA
        path = self.data_path(REGISTRY)
        return self.spark.read.parquet(path) if path else self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def update_registry(self, new: DataFrame) -> DataFrame:
        """S8 persisted: upsert new fingerprints into the registry."""
        from cohortlab.sources.datasets import upsert_fingerprints
        self._switch(REGISTRY, self._commit(REGISTRY, "data", upsert_fingerprints(self.registry(), new)))
        return self.registry()

    # ---- distributions
    def _distribution_path(self, kind: str) -> str:
        if kind not in DISTRIBUTIONS:
            raise ValueError(f"unknown distribution {kind!r}; known: {sorted(DISTRIBUTIONS)}")
        return f"{self.root}/_distributions/{kind}"

    def save_distribution(self, kind: str, name: str, table: DataFrame, cols: list[str]) -> None:
        """Replace the ``kind`` distribution of columns ``cols`` of a dataset by the rows of ``table`` (with a
        ``col_name``).  Only those columns' partitions are written (dynamic partition overwrite); a column
        without rows, say one that is no longer numeric, loses its old partition."""
        path = self._distribution_path(kind)
        rows = table.select(*[x.split()[0] for x in DISTRIBUTIONS[kind].split(", ")], F.lit(name).alias("dataset"), "col_name")
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "col_name").parquet(path))
        kept = {r["col_name"] for r in self.load_distribution(kind, name).select("col_name").distinct().collect()}
        present = {r["col_name"] for r in table.select("col_name").distinct().collect()}
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for c in set(cols) & kept - present:
            self._delete(f"{path}/dataset={escape(name)}/col_name={escape(c)}")

    def load_distribution(self, kind: str, name: str | None = None) -> DataFrame:
        """``(dataset, col_name, ...)`` of one dataset or all; the filter prunes partitions."""
        path = self._distribution_path(kind)
        schema = f"{DISTRIBUTIONS[kind]}, dataset string, col_name string"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(path)
        return out if name is None else out.where(out["dataset"] == name)
