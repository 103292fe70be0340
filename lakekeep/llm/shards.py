"""Arrays in numbered shards: stored by Spark below the shared folder, read by tasks one shard at a time."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekeep.session import work_path

#: Up to so many bytes of arrays a Python worker holds at once.
RESIDENT = 128 << 20


def store_shards(shards: DataFrame, name: str) -> tuple[str, int]:
    """Write rows (shard int, arrays as binary columns), one for each shard; returns the place and the arrays' bytes."""
    path = work_path(shards.sparkSession, f"llm-{name}")
    shards.write.partitionBy("shard").parquet(path)
    held = [F.octet_length(f.name) for f in shards.schema if f.dataType.typeName() == "binary"]
    size = sum(held[1:], held[0])
    stored = shards.sparkSession.read.schema(shards.schema).parquet(path)
    return path, stored.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


class Shards:
    """The shards of a stored table as a task sees them; those used least recently make room beyond `most` bytes.

    `parse` turns the row of a shard (a dictionary) into what is looked up in. A shard
    without a row is None.
    """

    def __init__(self, path: str, parse: Callable[[dict], Any], most: int = RESIDENT):
        self.parse, self.most = parse, most
        self.files, self.root = fs.FileSystem.from_uri(path)
        self.held: OrderedDict[int, tuple[Any, int]] = OrderedDict()
        self.bytes = 0

    def get(self, shard: int) -> Any:
        if shard in self.held:
            self.held.move_to_end(shard)
            return self.held[shard][0]
        row, size = self._read(shard)
        while self.held and self.bytes + size > self.most:
            self.bytes -= self.held.popitem(last=False)[1][1]
        self.held[shard] = (None if row is None else self.parse(row), size)
        self.bytes += size
        return self.held[shard][0]

    def _read(self, shard: int) -> tuple[dict | None, int]:
        folder = fs.FileSelector(f"{self.root}/shard={shard}", allow_not_found=True)
        names = [i.path for i in self.files.get_file_info(folder) if i.base_name.endswith(".parquet")]
        for name in sorted(names):
            with self.files.open_input_file(name) as f:
                rows = pq.read_table(f).to_pylist()
            if rows:
                return rows[0], sum(len(v) for v in rows[0].values() if isinstance(v, bytes))
        return None, 0
