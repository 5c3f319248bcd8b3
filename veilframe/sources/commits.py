"""Numbered commits beside data: what readers may see, switched by one file at a time."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_DIGITS = 20
# A commit is a few lines of text; one that is unreadable for so long was left by a lost writer.
ABANDONED_SECONDS = 5.0


class Folder:
    """A folder on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        at = self._hadoop_path(self.path)
        self._files = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop_path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> dict[str, float]:
        """Names in the folder and when each was last changed, in epoch seconds."""
        at = self._hadoop_path(self.path)
        if not self._files.exists(at):
            return {}
        found = self._files.listStatus(at)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}

    def read(self, name: str) -> str:
        stream = self._files.open(self._hadoop_path(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; false if there is one of that name already."""
        if self._files.getScheme() == "file":
            # Hadoop's local file system looks first and creates afterwards; the real one can do both at once.
            folder = self._hadoop_path(self.path).toUri().getPath()
            os.makedirs(folder, exist_ok=True)
            try:
                with open(f"{folder}/{name}", "x", encoding="utf-8") as file:
                    file.write(text)
            except FileExistsError:
                return False
            return True
        try:
            stream = self._files.create(self._hadoop_path(f"{self.path}/{name}"), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self._files.delete(self._hadoop_path(f"{self.path}/{name}"), True)


class CommitLog:
    """States of something, each a numbered file that is written once and never changed.

    The state in force is the highest number that can be read. A new state takes the next number
    with an exclusive create, so of two writers one finds its number taken and starts over from
    the other's state; a writer lost half-way leaves the state before it in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._folder = Folder(spark, path)

    def _numbers(self) -> list[int]:
        stems = (name.removesuffix(".json") for name in self._folder.names() if name.endswith(".json"))
        return sorted((int(stem) for stem in stems if stem.isdigit()), reverse=True)

    def _state(self, number: int) -> dict | None:
        try:
            return json.loads(self._folder.read(f"{number:0{_DIGITS}}.json"))
        except json.JSONDecodeError:
            return None

    def states(self, count: int = 1) -> list[tuple[int, dict]]:
        """The newest states that can be read, newest first."""
        found = []
        for number in self._numbers():
            if len(found) == count:
                break
            if (state := self._state(number)) is not None:
                found.append((number, state))
        return found

    def current(self) -> dict:
        newest = self.states()
        return newest[0][1] if newest else {}

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Puts ``change(current state)`` in force and returns it."""
        waited = 0.0
        while True:
            numbers = self._numbers()
            if numbers and self._state(numbers[0]) is None and waited < ABANDONED_SECONDS:
                # Being written by someone else, whose state must not be overlooked.
                time.sleep(0.1)
                waited += 0.1
                continue
            state = change(self.current())
            if self._folder.create(f"{(numbers or [0])[0] + 1:0{_DIGITS}}.json", json.dumps(state)):
                return state

    def forget(self, keep: int) -> None:
        """Deletes all but the newest states."""
        kept = {number for number, _ in self.states(keep)}
        for number in self._numbers():
            if kept and number < min(kept):
                self._folder.delete(f"{number:0{_DIGITS}}.json")
