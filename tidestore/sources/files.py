"""File system calls on whatever system a path is on, through the cluster's own client."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_dir: bool
    size: int
    modified: int  # milliseconds since 1970


class Files:
    """Lists, moves and deletes. Only names and sizes come to the driver, never contents of data files."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def list(self, path: str) -> list[Entry]:
        """Entries of a directory by name; none if it isn't there."""
        if not self.exists(path):
            return []
        found = self._fs(path).listStatus(self._path(path))
        return sorted((Entry(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in found), key=lambda e: e.name)

    def make(self, path: str) -> None:
        if not self._fs(path).mkdirs(self._path(path)):
            raise OSError(f"can't make {path}")

    def move(self, source: str, target: str) -> None:
        if not self._fs(source).rename(self._path(source), self._path(target)):
            raise OSError(f"can't move {source} to {target}")

    def delete(self, path: str) -> bool:
        return self._fs(path).delete(self._path(path), True)

    def write_text(self, path: str, text: str) -> None:
        """Written beside and then moved, so that a reader sees all of it or none."""
        hidden = path.rsplit("/", 1)
        hidden = f"{hidden[0]}/.{hidden[1]}.tmp"
        out = self._fs(path).create(self._path(hidden), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(path):
            self.delete(path)
        self.move(hidden, path)

    def claim(self, path: str, text: str) -> bool:
        """Write a file that mustn't be there yet; whether it wasn't."""
        try:
            out = self._fs(path).create(self._path(path), False)
        except Exception:
            if self.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read_text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
