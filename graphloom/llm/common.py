"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed, shared_folder

__all__ = ["BLANK", "checkpointed", "fresh", "give_back", "join_skewed", "names_apart", "remove", "shared_folder", "small_batches", "table", "text_or_empty"]
#: ASCII white space as a Java character class.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is in none of the taken ones (compared without case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def names_apart(*outputs: str) -> Callable:
    """For operators (docs, ..., id_col) that return the id beside ``outputs``: an id column of such a name keeps it, and the output gets a ``_`` before its own."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(*args, **options) -> DataFrame:
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            docs, id_col = bound.arguments["docs"], bound.arguments["id_col"]
            if id_col.lower() not in map(str.lower, outputs):
                return operator(*args, **options)
            safe = fresh("row_id", [*docs.columns, *outputs])
            bound.arguments["docs"] = docs.withColumnRenamed(id_col, safe)
            bound.arguments.update({k: safe for k in ("id_col", "text_col") if bound.arguments.get(k) == id_col})
            out = operator(*bound.args, **bound.kwargs)
            return out.select(*(F.col(c).alias(id_col if c == safe else fresh(c, [id_col])) for c in out.columns))

        return run

    return wrap


def join_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, most: int = 1000, least: int = 1000) -> DataFrame:
    """Inner join with a right side that has one row for each key and, in ``weight``, about how many rows of the left side have it.

    The (at most ``most``) heaviest keys of ``least`` rows or more go to every task, so their rows stay
    where they are; the others, none of them heavy, meet in a shuffle.
    """
    right = checkpointed(right)
    hot = F.broadcast(right.where(F.col(weight) >= least).orderBy(F.desc(weight), key).limit(most))
    names = hot.select(key)
    cold = left.join(F.broadcast(names), key, "left_anti").join(right.join(F.broadcast(names), key, "left_anti"), key)
    return left.join(hot, key).unionByName(cold)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Lets no more rows than these travel to Python at a time, in this session: rows hold whole texts."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers outlive their tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
