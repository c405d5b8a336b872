"""Files of any Hadoop file system, by the driver's JVM: whole or not there, and created once where that matters."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class AlreadyThere(FileExistsError):
    """Something create-only exists with other content."""


class Folder:
    """A folder on whatever file system its path names; without a scheme, the session's default one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.setWriteChecksum(False)  # of local files: no .crc beside them

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def matching(self, pattern: str) -> set[str]:
        """Paths below the folder that match a pattern with *, relative to it: one listing for many names."""
        found = self._fs.globStatus(self._path(pattern)) or []
        base = self._fs.makeQualified(self._path("")).toUri().getPath()
        return {s.getPath().toUri().getPath()[len(base) + 1 :] for s in found}

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def move(self, source: str, target: str) -> None:
        """Rename inside the folder; a target that exists is an error."""
        self._fs.mkdirs(self._path(target).getParent())
        if self.exists(target) or not self._fs.rename(self._path(source), self._path(target)):
            raise AlreadyThere(self.path(target))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A new file in a folder that no one else writes to."""
        self._create(name, text, False)

    def claim(self, name: str, text: str = "") -> bool:
        """Create a file that must not exist; False if it does. Of several writers one succeeds."""
        try:
            self._create(name, text, False)
            return True
        except Exception:
            if self.exists(name):
                return False
            raise

    def write(self, name: str, text: str, create_only: bool = False) -> None:
        """A whole file or none: written beside its place and renamed. create_only: the same text again is fine."""
        if create_only and self.exists(name):
            if self.read(name) == text:
                return
            raise AlreadyThere(self.path(name))
        temp = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/")
        self._create(temp, text, False)
        if not create_only and self.exists(name):
            self._fs.delete(self._path(name), False)
        if not self._fs.rename(self._path(temp), self._path(name)):
            self.delete(temp)
            raise AlreadyThere(self.path(name))
