"""Small control files in any file system that Spark knows, through its Hadoop interface."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """Files under one folder; paths are relative to it."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()
        self.jvm, self.folder = self.spark._jvm, folder.rstrip("/")
        self.conf = self.spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, without hidden ones; none if it is absent."""
        there = self.fs.listStatus(self._path(name)) if self.exists(name) else []
        return sorted(n for s in there if not (n := s.getPath().getName()).startswith("."))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isDirectory()

    def modified_ms(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(name)).getModificationTime()

    def read_json(self, name: str) -> object:
        """The value of a JSON file, or None if it is absent or can't be read."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _write(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()

    def write_json(self, name: str, value: object) -> None:
        """Replace a JSON file at once; NaN is refused."""
        data = json.dumps(value, ensure_ascii=False, allow_nan=False).encode()
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        try:
            self._write(temporary, data, True)
            kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
            how = self.spark._sc._gateway.new_array(kinds, 1)
            how[0] = kinds.OVERWRITE
            source = self.fs.makeQualified(self._path(temporary))
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, self.fs.makeQualified(self._path(name)), how)
        finally:
            if self.exists(temporary):
                self.remove(temporary)

    def create(self, name: str) -> bool:
        """Create an empty file that is not there yet; False if it is."""
        try:
            self.fs.create(self._path(name), False).close()
        except Exception as e:
            if self.exists(name):
                return False
            raise OSError(f"{name} can't be created") from e
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def move_to(self, target: Files, name: str = "", new: str = "") -> None:
        """Move a file or folder within one file system."""
        if not self.fs.rename(self._path(name), target._path(new)):
            raise OSError(f"{self.path(name)} can't be moved")
