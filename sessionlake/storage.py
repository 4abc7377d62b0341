"""Small files and folders of an archive, by a path or a URI: local disks directly, any other store through Hadoop's file systems."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


class Exists(Exception):
    """Another writer was first."""


class Store:
    """One archive's folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        scheme = root.split("://", 1)[0] if "://" in root else "file"
        self.local = scheme == "file"

    def _disk(self, name: str) -> Path:
        return Path(self.root.removeprefix("file://"), name)

    def _remote(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        if self.local:
            p = self._disk(folder)
            return sorted(os.listdir(p)) if p.is_dir() else []
        fs, p = self._remote(self.at(folder))
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, folder: str) -> list[str]:
        """Parquet files at any depth below a folder, by their names below the root."""
        if self.local:
            return sorted(str(p.relative_to(self._disk(""))) for p in self._disk(folder).rglob("*.parquet"))
        fs, p = self._remote(self.at(folder))
        if not fs.exists(p):
            return []
        found, out, head = fs.listFiles(p, True), [], fs.makeQualified(self._remote(self.root)[1]).toString()
        while found.hasNext():
            path = found.next().getPath().toString()
            if path.endswith(".parquet"):
                out.append(path[len(head) + 1 :])
        return sorted(out)

    def read(self, name: str) -> str:
        if self.local:
            return self._disk(name).read_text()
        fs, p = self._remote(self.at(name))
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file that must not exist; whole or not at all."""
        if self.local:
            target = self._disk(name)
            target.parent.mkdir(parents=True, exist_ok=True)
            staged = target.parent / f".{uuid.uuid4().hex}"
            staged.write_text(text)
            try:
                os.link(staged, target)
            except FileExistsError:
                raise Exists(name) from None
            finally:
                staged.unlink()
            return
        fs, p = self._remote(self.at(name))
        from py4j.protocol import Py4JJavaError

        try:
            stream = fs.create(p, False)  # the store refuses a file that exists
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e):
                raise Exists(name) from None
            raise
        stream.write(text.encode())
        stream.close()

    def exists(self) -> bool:
        if self.local:
            return self._disk("").exists()
        fs, p = self._remote(self.root)
        return fs.exists(p)

    def delete(self, name: str = "") -> None:
        if self.local:
            shutil.rmtree(self._disk(name), ignore_errors=True)
            return
        fs, p = self._remote(self.at(name) if name else self.root)
        fs.delete(p, True)

    def rename(self, root: str) -> None:
        """Moves the whole folder to a place that doesn't exist."""
        if self.local:
            os.rename(self._disk(""), root.removeprefix("file://"))
        else:
            fs, p = self._remote(self.root)
            if not fs.rename(p, self._remote(root)[1]):
                raise Exists(root)
        self.root = root
