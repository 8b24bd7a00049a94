"""The few file operations the catalog needs, on any store that Hadoop's client reaches; on the driver's own disk they go
without it, for its client starts a process for each new file.

A lock names its owner and the time until which it holds; one that is over is taken away by the next writer, by a rename
that only one of them can do. The catalog's commits are short, so a lock outlives only a writer that died. And should a
writer be held up beyond its lease, ``publish`` never replaces a file, so of two writers one commits and the other fails.
Both hold where creating a file and renaming one are atomic, and neither replaces what is there: on local disks and HDFS.
On object stores they aren't; there a database must have one writer at a time.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid

from pyspark.sql import SparkSession

from marlstone.errors import LockTimeoutError


LEASE_SECONDS = 60.0


class Files:
    """On the driver's disk, in a folder."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _path(self, name: str) -> str:
        return f"{local(self.root)}/{name}" if name else local(self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return os.listdir(path) if os.path.isdir(path) else []

    def read(self, name: str) -> str:
        with open(self._path(name), encoding="utf-8") as f:
            return f.read()

    def publish(self, name: str, text: str) -> None:
        """Writes beside the file and then gives it its name, so that a reader finds all of it or nothing. An error if there
        is such a file."""
        path = self._path(name)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(beside, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(beside, path)
        except FileExistsError:
            raise
        except OSError:  # a disk without links
            if os.path.exists(path):
                raise FileExistsError(path) from None
            shutil.copyfile(beside, f"{beside}.2")
            os.replace(f"{beside}.2", path)
        finally:
            os.remove(beside)

    def delete(self, path: str) -> None:
        path = local(path)
        shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)

    def lock(self, name: str, seconds: float, lease: float = LEASE_SECONDS) -> str:
        """Returns the owner's name, for unlock(). Waits so many seconds for another writer."""
        owner, until = uuid.uuid4().hex, time.monotonic() + seconds
        while not self._created(name, json.dumps({"owner": owner, "until": time.time() + lease})):
            if self._over(name):
                self._move(name, f"{name}.{owner}.over")
            elif time.monotonic() > until:
                raise LockTimeoutError(f"another writer holds {self.root}/{name}")
            else:
                time.sleep(0.02)
        return owner

    def _over(self, name: str) -> bool:
        """Whether the lock's lease has ended. One that can't be read yet is being made, or gone."""
        try:
            return json.loads(self.read(name))["until"] < time.time()
        except Exception:
            return False

    def unlock(self, name: str, owner: str) -> None:
        """Removes the lock unless another writer has taken it over."""
        try:
            own = json.loads(self.read(name))["owner"] == owner
        except Exception:
            return
        if own:
            self._remove(name)

    def _created(self, name: str, text: str) -> bool:
        try:
            self.publish(name, text)
            return True
        except FileExistsError:
            return False

    def _move(self, name: str, to: str) -> None:
        """Of several writers only one finds the file."""
        try:
            os.rename(self._path(name), self._path(to))
            os.remove(self._path(to))
        except FileNotFoundError:
            pass

    def _remove(self, name: str) -> None:
        os.remove(self._path(name))


class HadoopFiles(Files):
    """On any other store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(root)
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        beside = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # a local disk's client renames over what is there; HDFS doesn't
        if self.fs.exists(self._path(name)) or not self.fs.rename(beside, self._path(name)):
            self.fs.delete(beside, False)
            raise FileExistsError(f"{self.root}/{name}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)

    def _move(self, name: str, to: str) -> None:
        if self.fs.rename(self._path(name), self._path(to)):
            self.fs.delete(self._path(to), False)

    def _remove(self, name: str) -> None:
        self.fs.delete(self._path(name), False)


def local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def files(spark: SparkSession, root: str) -> Files:
    """For a folder given with or without a scheme; without one it is on Hadoop's default store."""
    root = root.rstrip("/")
    scheme = re.match(r"(\w+):/", root)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if scheme[1] == "file" if scheme else default.startswith("file:"):
        return Files(root)
    return HadoopFiles(spark, root)
