"""Files of any Hadoop store, from the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """The Hadoop file system of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self._sc = spark.sparkContext
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._sc._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._sc._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def files(self, path: str) -> list[tuple[str, int]]:
        """Full path and bytes of the visible files directly in a folder."""
        p = self._path(path)
        found = self._fs.listStatus(p) if self._fs.exists(p) else []
        return [(s.getPath().toString(), s.getLen()) for s in found if s.isFile() and s.getPath().getName()[0] not in "._"]

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, claim_seconds: int = 60) -> bool:
        """Write a new file; False if another writer was first.  The text is complete before the name appears.

        A writer claims the name by an exclusive create of a file with a token of its own; a claim older than
        claim_seconds without its file is left over from a lost writer and is taken away.  The text is written
        under a name no other writer uses, and appears by a rename only while the claim still has the writer's token and
        the name is free; what then stands under the name decides who was first.
        """
        token = uuid.uuid4().hex
        claim = self._path(f"{path}.claim")
        if self._fs.exists(claim) and not self.exists(path):
            age = self._sc._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(claim).getModificationTime()
            if age > 1000 * claim_seconds:
                self._fs.delete(claim, False)
        try:
            self._write(claim, token)
        except Exception:  # the name is taken
            return False
        staged = self._path(f"{path}.{token}.tmp")
        self._write(staged, text)
        if not self._owns(claim, token) or self.exists(path) or not self._fs.rename(staged, self._path(path)):
            self._fs.delete(staged, False)
            return False
        return self._owns(claim, token) and self.read(path) == text

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _owns(self, claim, token: str) -> bool:
        try:
            return self.read(claim.toString()) == token
        except Exception:  # taken away meanwhile
            return False
