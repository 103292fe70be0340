"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.session import pinned

#: A word is a run of code points other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; columns with other names, clashing or not, are left behind.

    A name in another case is not taken for one of them.
    """
    found = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    safe = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return safe.select(*[F.col(f"_in{found[n]}").alias(n) for n in names])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    return pinned(df, f"llm-{name}")


#: Rows of one Arrow batch, where the session has Spark's default of ten times as many: texts are long.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship() -> SparkContext:
    """The running context, whose Python workers can import this package.

    The package goes to the executors as a zip file through Spark, once for
    each application. A session that leaves the size of Arrow batches at its default gets
    smaller ones, since both sides hold a whole batch of texts.
    """
    context = SparkContext.getOrCreate()
    session = SparkSession.active()
    if session.conf.get(BATCH_SETTING) == "10000":
        session.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "lakekeep_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return context


def broadcast(value) -> Broadcast:
    """A value of bounded size for the Python workers."""
    return ship().broadcast(value)
