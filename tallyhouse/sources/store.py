"""Tables as immutable generations below one root folder.

Parquet has no transactional replace, so a table is never overwritten: each
write goes to a new generation folder, and a one-line ``CURRENT`` file names the
generation readers use. Replacing that file is the commit. A failed or lost
write leaves the previous generation in place, and a reader of the old one keeps
its files.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CURRENT = "CURRENT"
#: Folder of the versions of a table that is kept by manifests.
MANIFESTS = "_manifests"


class Files:
    """The few file operations a store needs, on whatever file system Spark uses."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def children(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(
            s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))
        )

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        listed = self._fs(path).listStatus(self._path(path))
        return sorted(s.getPath().getName() for s in listed if s.isDirectory())

    def rename(self, path: str, to: str) -> None:
        """Move a file or folder to a place whose parent is made if need be."""
        self._fs(to).mkdirs(self._path(to).getParent())
        if not self._fs(path).rename(self._path(path), self._path(to)):
            raise OSError(f"cannot rename {path} to {to}")

    def read_line(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            reader = self._jvm.java.io.BufferedReader(
                self._jvm.java.io.InputStreamReader(stream, "UTF-8")
            )
            return reader.readLine()
        finally:
            stream.close()

    def replace_line(self, path: str, line: str) -> None:
        """Write a new file beside ``path`` and rename it over ``path``."""
        fresh = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs(fresh).create(self._path(fresh), True)
        try:
            stream.write(bytearray(line.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(path).toUri(), self._conf
        )
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(fresh), self._path(path), options)

    def publish(self, path: str, line: str) -> bool:
        """Make a file that must not exist yet; False if it does.

        The file appears with its content. A local link and a rename without
        replacement both fail when another writer was first.
        """
        fresh = f"{path}.{uuid.uuid4().hex}"
        self.replace_line(fresh, line)
        uri = self._fs(path).makeQualified(self._path(path)).toUri()
        try:
            if uri.getScheme() == "file":
                file = self._jvm.java.io.File
                self._jvm.java.nio.file.Files.createLink(
                    file(uri.getPath()).toPath(), file(self._path(fresh).toUri().getPath()).toPath()
                )
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf)
                rename = self._jvm.org.apache.hadoop.fs.Options.Rename
                options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
                options[0] = rename.NONE
                context.rename(self._path(fresh), self._path(path), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName() or self.exists(path):
                return False
            raise
        finally:
            self.delete(fresh)
        return True

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


class Store:
    """Named tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = self._files = Files(spark)

    def _table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def generation(self, name: str) -> str | None:
        folder = self._table(name)
        pointer = f"{folder}/{CURRENT}"
        if self._files.exists(pointer):
            return self._files.read_line(pointer)
        # Where replacing a file is a deletion and a copy, a crash in between leaves
        # the new pointer beside the old one's place.
        left = [f for f in self._files.children(folder) if f.startswith(f"{CURRENT}.")]
        lines = sorted(g for f in left if (g := self._files.read_line(f"{folder}/{f}")))
        committed = [g for g in lines if self._files.exists(f"{folder}/{g}/_SUCCESS")]
        return committed[-1] if committed else None

    def exists(self, name: str) -> bool:
        return self.generation(name) is not None

    def names(self) -> list[str]:
        """Tables with a pointer; those kept by manifests are not among them."""
        return [n for n in self._files.children(self.root) if self.exists(n)]

    def path(self, name: str) -> str:
        generation = self.generation(name)
        if generation is None:
            raise KeyError(f"no table {name!r} below {self.root}")
        return f"{self._table(name)}/{generation}"

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """The current generation; an empty table of ``schema`` when there is none."""
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if not self.exists(name):
            if schema is None:
                raise KeyError(f"no table {name!r} below {self.root}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read
        if schema is not None:
            df = reader.schema(schema).parquet(self.path(name))
            return df.select(schema.names)
        return reader.parquet(self.path(name))

    @staticmethod
    def new_generation() -> str:
        """A name that sorts after those of earlier generations."""
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        return f"gen={stamp}-{uuid.uuid4().hex[:8]}"

    def write(
        self,
        name: str,
        df: DataFrame,
        partition_by: str | None = None,
        generation: str | None = None,
    ) -> DataFrame:
        """Write a new generation, commit it and return it as a table."""
        generation = generation or self.new_generation()
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self._table(name)}/{generation}")
        self._files.replace_line(f"{self._table(name)}/{CURRENT}", generation)
        return self.read(name, df.schema)

    def drop(self, name: str) -> None:
        """Forget a table: without a pointer it does not exist."""
        for file in self._files.children(self._table(name)):
            if file.startswith(CURRENT):
                self._files.delete(f"{self._table(name)}/{file}")

    def expire(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` generations (the current one stays)."""
        current = self.generation(name)
        old = [
            g
            for g in self._files.children(self._table(name))
            if g.startswith("gen=") and self._files.exists(f"{self._table(name)}/{g}/_SUCCESS")
        ]
        for generation in old[: max(len(old) - keep, 0)]:
            if generation != current:
                self._files.delete(f"{self._table(name)}/{generation}")



def work_folder(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables, in the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Without it only a
    local session may go on, in a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tallyhouse-")
    return f"{base.rstrip('/')}/tallyhouse-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives the
    planner the real size of the table, so that it broadcasts it only if it is
    below the session's threshold.
    """
    path = f"{folder or work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
