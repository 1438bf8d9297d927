"""A store of derived tables that later jobs read.

Tables lie under ``<shared folder>/marquee-artifacts/<version>/``, the version being
a digest of the input files and of the code that derives tables from them. A table
is written to a folder of its own attempt and counts once its manifest entry, a
file that names this folder, exists; the entry is created last and only if there
is none yet, so readers never see half a table and of two jobs that build one at
a time the first to finish counts. Entries are listed through Hadoop's file
system, so the shared folder may be in any store.
"""

from __future__ import annotations

import hashlib
import pkgutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules whose code decides what a derived table holds.
CODE_PACKAGES = ("marquee.functions", "marquee.operators", "marquee.sources")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, the same for every session."""
    from marquee.session import ensure_checkpoint_dir
    own = ensure_checkpoint_dir(spark)  # a folder of this session below it
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or own).rstrip("/")


def code_version() -> str:
    digest = hashlib.sha1()
    for package in CODE_PACKAGES:
        paths = __import__(package, fromlist=["x"]).__path__
        for module in sorted(m.name for m in pkgutil.iter_modules(paths)):
            digest.update(module.encode() + (pkgutil.get_data(package, f"{module}.py") or b""))
    return digest.hexdigest()[:12]


class Store:
    def __init__(self, spark: SparkSession, version: str, root: str | None = None):
        self.spark, self.version = spark, version
        self.root = f"{root or shared_root(spark)}/marquee-artifacts"
        self.base = f"{self.root}/{version}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def entry(self, name: str) -> str | None:
        """The folder of a complete table, by its manifest entry."""
        p, fs = self._fs(f"{self.base}/manifest/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return f"{self.base}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def tables(self) -> list[str]:
        return [n for n in self._names(f"{self.base}/manifest") if not n.startswith(".")]

    def _commit(self, name: str, folder: str) -> None:
        p, fs = self._fs(f"{self.base}/manifest/{name}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):  # another job was first
                return
            raise e
        try:
            out.write(bytearray(folder.encode()))
        finally:
            out.close()

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and enter it; return the entered one."""
        folder = f"data/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.base}/{folder}")
        self._commit(name, folder)
        return self.read(name)

    def read(self, name: str) -> DataFrame | None:
        path = self.entry(name)
        return None if path is None else self.spark.read.parquet(path)

    def get_or_build(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        found = self.read(name)
        return self.write(name, build()) if found is None else found

    def versions(self) -> list[str]:
        """All versions in the store, the newest last."""
        p, fs = self._fs(self.root)
        found = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []
        return [n for _, n in sorted(found)]

    def remove_old(self, keep: int = 1) -> list[str]:
        """Delete all versions but this one and the ``keep`` newest others; return what went.

        Only folders with a manifest are versions of this store."""
        others = [v for v in self.versions() if v != self.version and "manifest" in self._names(f"{self.root}/{v}")]
        gone = others[:max(len(others) - keep, 0)]
        for v in gone:
            p, fs = self._fs(f"{self.root}/{v}")
            fs.delete(p, True)
        return gone
