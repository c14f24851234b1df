"""File-system operations on any Hadoop path, WebHDFS among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Status:
    path: str
    is_dir: bool
    length: int
    owner: str
    permission: str


class Files:
    """Hadoop's FileSystem; errors are those that Hadoop raises."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        hpath = self.jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.conf), hpath

    def _status(self, s) -> Status:
        return Status(s.getPath().toString(), s.isDirectory(), s.getLen(), s.getOwner(), s.getPermission().toString())

    def home(self, path: str = "/") -> str:
        return self._at(path)[0].getHomeDirectory().toString()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def status(self, path: str) -> Status:
        fs, p = self._at(path)
        return self._status(fs.getFileStatus(p))

    def list(self, path: str) -> list[Status]:
        fs, p = self._at(path)
        return sorted((self._status(s) for s in fs.listStatus(p)), key=lambda s: s.path)

    def summary(self, path: str) -> tuple[int, int, int]:
        """(bytes, files, folders)."""
        fs, p = self._at(path)
        s = fs.getContentSummary(p)
        return s.getLength(), s.getFileCount(), s.getDirectoryCount()

    def create(self, path: str, data: bytes, overwrite: bool = False) -> None:
        fs, p = self._at(path)
        out = fs.create(p, overwrite)
        out.write(data)
        out.close()

    def append(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        out = fs.append(p)
        out.write(data)
        out.close()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def mkdirs(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.mkdirs(p)

    def rename(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to))

    def delete(self, path: str, recursive: bool = False) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, recursive)

    def set_permission(self, path: str, octal: str) -> None:
        fs, p = self._at(path)
        fs.setPermission(p, self.jvm.org.apache.hadoop.fs.permission.FsPermission(octal))

    def set_owner(self, path: str, owner: str | None, group: str | None) -> None:
        fs, p = self._at(path)
        fs.setOwner(p, owner, group)
