"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import AbstractContextManager
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, else the one that spark.checkpoint.dir names. Only a local session may do without: a temporary folder of the driver is no good to executors elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_root(spark)}/tables/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends here and survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def opened(path: str) -> AbstractContextManager[BinaryIO]:
    """A file for reads at any place: a local path, or an address of a store that pyarrow knows."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)
