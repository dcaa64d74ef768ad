"""Tables written in the shared folder of the cluster: they cut lineage and outlive executors.

The folder is the one named in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
a temporary folder is made and set. Files are written by Spark, so any Hadoop file system serves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path without a trailing slash."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set(_KEY, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path written by this module; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stages:
    """Written tables of one operator run. ``drop`` frees the disk of those that are no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, fresh_path(spark, label), 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return it reread, with the same schema (all columns nullable)."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._quern_path)


_FOLDERS: list[str] = []


def _own_folder() -> str:
    """A folder of this worker process for copies, removed at its end."""
    if not _FOLDERS:
        _FOLDERS.append(tempfile.mkdtemp(prefix="quern-lm-"))
        atexit.register(shutil.rmtree, _FOLDERS[0], True)
    return _FOLDERS[0]


class Store:
    """Arrays in a folder that all workers share."""

    def __init__(self, folder: str):
        self.folder = folder
        self.mounted = folder.removeprefix("file://") if folder.startswith(("file://", "/")) else None

    def _fs(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder)

    def put(self, name: str, array: np.ndarray) -> None:
        if self.mounted:
            os.makedirs(self.mounted, exist_ok=True)
            part = f"{self.mounted}/.{name}-{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, f"{self.mounted}/{name}")
        else:
            fs, path = self._fs()
            fs.create_dir(path)
            part = f"{path}/_{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(array.tobytes())
            fs.move(part, f"{path}/{name}")

    def get(self, name: str, dtype) -> np.ndarray:
        """Memory-mapped; read-only. Empty where nothing was put."""
        if self.mounted:
            path = f"{self.mounted}/{name}"
            if not os.path.exists(path):
                return np.empty(0, dtype)
        else:
            path = os.path.join(_own_folder(), f"{os.path.basename(self.folder)}-{name}")
            if not os.path.exists(path):
                from pyarrow.fs import FileType

                fs, there = self._fs()
                if fs.get_file_info(f"{there}/{name}").type == FileType.NotFound:
                    return np.empty(0, dtype)
                with fs.open_input_stream(f"{there}/{name}") as f, open(part := f"{path}-{uuid.uuid4().hex}", "wb") as out:
                    while chunk := f.read(1 << 22):
                        out.write(chunk)
                os.replace(part, path)
        return np.memmap(path, dtype=dtype, mode="r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, dtype)
