"""A ledger of numbered states: each a small JSON file that counts once it is whole."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from lakekeep.session import hadoop_path

# States that are kept; earlier ones are deleted by the commit that makes them too many.
KEPT = 20


class LedgerConflict(RuntimeError):
    """Another writer has committed since the state was read."""


class Ledger:
    """States of a job or a store, one file each, in a folder of any file system that Spark knows.

    A commit creates the file of the next number, which fails where it exists
    already, so of two writers one is told. A file that a crash left unfinished is no state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.at = hadoop_path(spark, self.path)

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self.at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def _file(self, number: int):
        return hadoop_path(self.spark, f"{self.path}/{number:012d}.json")[1]

    def _read(self, number: int) -> dict | None:
        stream = self.fs.open(self._file(number))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def last(self) -> tuple[int, dict | None]:
        """The highest number in use and the newest whole state; (0, None) for a new ledger."""
        numbers = self._numbers()
        for number in reversed(numbers):
            state = self._read(number)
            if state is not None:
                return numbers[-1], state
        return (numbers[-1] if numbers else 0), None

    def commit(self, state: dict, after: int) -> int:
        """Write the state that follows number `after`; returns its own."""
        number = after + 1
        if self.fs.exists(self._file(number)):
            raise LedgerConflict(f"{self.path} has a state {number} already")
        try:
            stream = self.fs.create(self._file(number), False)
        except Exception as error:
            if self.fs.exists(self._file(number)):
                raise LedgerConflict(f"{self.path} has a state {number} already") from error
            raise
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            stream.close()
        for old in self._numbers()[:-KEPT]:
            self.fs.delete(self._file(old), False)
        return number
