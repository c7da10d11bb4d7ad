"""Numbered versions of a folder in any store that Spark writes to, each one small file.

A version is a JSON value in ``published/<number>``; it names the folders that it is made
of. Publishing puts the next number if it is absent, and that alone decides who was first:
on a local disk by a link, elsewhere by a rename that doesn't replace. A publisher that
comes second is asked again, with the winner's version, so that no update is lost.

Readers take out leases on the folders that they read. A version goes when it was replaced
long enough ago and none of its folders has a lease; its folders go when no version that is
left names them. A publisher's folders aren't named before it is done, so they never go.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds that a replaced version stays, and that a lease holds.
KEPT, LEASE = 3600, 24 * 3600
_DIGITS = 12


class Versions:
    """The versions below a folder; ``folders`` tells which folders below it a version names."""

    def __init__(self, spark: SparkSession, root: str, folders: Callable[[dict], set[str]] = lambda content: set(content["folders"])):
        self.spark, self.root, self.folders = spark, root.rstrip("/"), folders
        self._leases: dict[str, float] = {}

    def fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self.fs(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self.fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new small file; an error if it is there."""
        fs, p = self.fs(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, path: str) -> None:
        fs, p = self.fs(path)
        fs.delete(p, True)

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds of its last change) of the files in a folder below the root."""
        fs, p = self.fs(f"{self.root}/{folder}")
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted((f.getPath().getName(), f.getModificationTime() / 1000) for f in found)

    def numbers(self) -> list[int]:
        return [int(n) for n, _ in self._listed("published") if n.isdigit()]

    def at(self, number: int) -> dict:
        return json.loads(self.read(f"{self.root}/published/{number:0{_DIGITS}d}"))

    def newest(self) -> tuple[int, dict] | None:
        """The published version; None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else None

    def moved(self, source: str, target: str, replace: bool = False) -> bool:
        """Renames a file in one step; False if the target is there and isn't to be replaced."""
        fs, p = self.fs(target)
        if fs.getScheme() == "file":
            a, b = (self.fs(x)[1].toUri().getPath() for x in (source, target))
            os.makedirs(os.path.dirname(b), exist_ok=True)
            with contextlib.suppress(FileNotFoundError):
                os.unlink(os.path.join(os.path.dirname(a), f".{os.path.basename(a)}.crc"))
            if replace:
                os.replace(a, b)
                return True
            try:
                os.link(a, b)
            except FileExistsError:
                return False
            finally:
                os.unlink(a)
            return True
        fs.mkdirs(p.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            hadoop.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self.fs(source)[1], p, how)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                self.delete(source)
                return False
            raise
        return True

    def put(self, number: int, content: dict) -> bool:
        """Publishes a version of this number, unless there is one."""
        waiting = f"{self.root}/waiting/{uuid.uuid4().hex}"
        self.write(waiting, json.dumps(content))
        return self.moved(waiting, f"{self.root}/published/{number:0{_DIGITS}d}")

    def commit(self, make: Callable[[dict | None], dict | None], lost: Callable[[dict], None] = lambda content: None) -> tuple[int, dict] | None:
        """Publishes what ``make`` says of the newest version, None for nothing; says it again of a version that came first."""
        while True:
            number, before = self.newest() or (0, None)
            content = make(before)
            if content is None:
                return None
            if self.put(number + 1, content):
                return number + 1, content
            lost(content)

    def hold(self, folder: str) -> None:
        """A lease on a folder, renewed when half of it is over."""
        if folder not in self._leases or self._leases[folder] < time.monotonic() - LEASE / 2:
            self.write(f"{self.root}/leases/{folder}.{uuid.uuid4().hex}", "")
            self._leases[folder] = time.monotonic()

    def clean(self) -> list[str]:
        """Deletes versions that were replaced long ago and aren't held, and the folders that only they named; these folders."""
        listed = [(n, t) for n, t in self._listed("published") if n.isdigit()]
        if not listed:
            return []
        now, held = listed[-1][1], set()
        for name, t in self._listed("leases"):
            if now - t < LEASE:
                held.add(name.partition(".")[0])
            else:
                self.delete(f"{self.root}/leases/{name}")
        old, left = [], []
        for (name, _), (_, replaced) in zip(listed, listed[1:] + [(None, now)], strict=True):
            own = self.folders(self.at(int(name)))
            gone = name != listed[-1][0] and now - replaced >= KEPT and not own & held
            (old if gone else left).append((name, own))
        for name, _ in old:
            self.delete(f"{self.root}/published/{name}")
        folders = set().union(*(own for _, own in old)) - set().union(*(own for _, own in left))
        for folder in folders:
            self.delete(f"{self.root}/{folder}")
        return sorted(folders)
