"""Files of a store through Hadoop's file systems, so that a store can lie wherever Spark writes."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .names import StoreError

#: File systems whose rename is atomic and leaves a target that is there alone.
ATOMIC = ("hdfs", "viewfs")
#: Object stores whose create() without overwriting is a put if absent: nothing is there before close(), and close() fails if another was first.
PUT_IF_ABSENT = ("gs",)
#: More of them, as a list of schemes in the session.
DECLARED = "spark.tallyrun.putIfAbsent"
#: The capability and option of file systems (S3A among them) for such a put.
CONDITIONAL = "fs.option.create.conditional.overwrite"


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._jvm = spark, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root))
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")
        self.scheme = self.root.partition(":")[0]
        declared = {x.strip() for x in (spark.conf.get(DECLARED, "") or "").split(",")}
        if self.scheme == "file":
            self._create_once = self._link
        elif self.scheme in ATOMIC:
            self._create_once = self._rename_in
        elif self._fs.hasPathCapability(path, CONDITIONAL):
            self._create_once = lambda path, data: self._put(path, data, lambda p: self._fs.createFile(p).must(CONDITIONAL, "true").build())
        elif self.scheme in PUT_IF_ABSENT or self.scheme in declared:
            self._create_once = lambda path, data: self._put(path, data, lambda p: self._fs.create(p, False))
        else:
            raise StoreError(f"a store can't be kept on {self.scheme}: it can't make a file whole and only once. If its create() without overwriting is a put if absent, name it in {DECLARED}")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        """What a folder holds; all names come over in one call."""
        if not self.exists(path):
            return []
        paths = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self._fs.listStatus(self._at(path)))
        text = self._jvm.scala.runtime.ScalaRunTime.stringOf(paths)[len("Array(") : -1]
        return sorted(p.rpartition("/")[2] for p in text.split(f", {path}/")) if text else []

    def quiet(self, path: str) -> float:
        """Seconds since anything in a folder has changed, down to the files of tasks that are under way."""
        newest = self._fs.getFileStatus(self._at(path)).getModificationTime()
        todo = [self._at(path)] if self._fs.getFileStatus(self._at(path)).isDirectory() else []
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                newest = max(newest, s.getModificationTime())
                if s.isDirectory():
                    todo.append(s.getPath())
        return time.time() - newest / 1000

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._at(path)).getLength()

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Write a new file that appears whole or not at all; False if there is one already.

        How is settled when the store is opened: local disks link, HDFS (also behind viewfs)
        renames, object stores put if absent. None replaces what is there. File systems that
        can do none of it are refused then, before anything is written.
        """
        return self._create_once(path, data)

    def _link(self, path: str, data: bytes) -> bool:
        target = path.removeprefix("file:").replace("//", "/", 1)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{target}.{uuid.uuid4().hex}.draft"
        with open(draft, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True

    def _rename_in(self, path: str, data: bytes) -> bool:
        if self.exists(path):
            return False
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._at(draft), False)
        try:
            stream.write(data)
        finally:
            stream.close()
        try:
            made = self._fs.rename(self._at(draft), self._at(path))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            made = False
        if not made:
            self._fs.delete(self._at(draft), False)
            if not self.exists(path):
                raise OSError(f"{path} could not be made")
        return made

    def _put(self, path: str, data: bytes, opened) -> bool:
        """A put that may fail although it was done: a client that got no answer asks again and is told that the file is there. So what is there is compared."""
        try:
            stream = opened(self._at(path))
            stream.write(data)
            stream.close()
            return True
        except Py4JJavaError:
            if not self.exists(path):
                raise
            return self.read(path) == data

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._at(new).getParent())
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)
