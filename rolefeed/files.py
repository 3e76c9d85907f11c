"""Folders of any file system that Spark reaches: list, move, remove.

The driver calls the file system that Spark itself uses; data goes through DataFrames only.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _located(spark, path)
    return system.exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    place, system = _located(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder in one step. Something at ``target`` already is an error."""
    place, system = _located(spark, source)
    goal, _ = _located(spark, target)
    system.mkdirs(goal.getParent())
    if system.exists(goal) or not system.rename(place, goal):
        raise FileExistsError(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it, if it is there."""
    place, system = _located(spark, path)
    system.delete(place, True)
