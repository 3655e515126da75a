"""Column names that never clash with a caller's, and shared folders."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """These names, with underscores until no column of docs has them in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: as the session names it, a temporary one only in local mode and only where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="textloom-"))
    return context.getCheckpointDir().rstrip("/")
