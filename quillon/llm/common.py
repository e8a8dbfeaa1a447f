"""Helpers that several operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from ..sources.folders import shared_base

#: The bytes that separate words, and words as everything between them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark application.

    Workers started from another folder, or on another machine, get a zip of the package by Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "quillon_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._quillon_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    if (made := _gathering.get()) is not None:
        made.append(back)
    return back


_gathering: ContextVar[list[DataFrame] | None] = ContextVar("gathering", default=None)


@contextmanager
def gathered() -> Iterator[list[DataFrame]]:
    """The frames that `stored` gives inside, so that those which no result needs any more can be discarded."""
    token = _gathering.set(made := [])
    try:
        yield made
    finally:
        _gathering.reset(token)


def discard(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for these frames. Nothing that is still to be computed may read them; other frames are passed over."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            Files(df.sparkSession).delete(path)


def text_of(column: str = "text") -> Column:
    """The text, an empty string for null."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
