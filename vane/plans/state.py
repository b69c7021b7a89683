"""Fitted models as tables in a folder: a folder a model, in it one a save, and a pointer to the save that counts."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.plans import files


def save_state(states: dict[str, DataFrame], path: str, versions: dict[str, int]) -> None:
    """Each model's table under path/name, with its version in every row. Only when it is whole does the pointer go over to it, and
    the save before last is dropped: a save that fails leaves the model as it was, and readers of the last save can end."""
    for name, state in states.items():
        spark, save = state.sparkSession, f"save-{uuid.uuid4().hex}"
        last = files.read_text(spark, f"{path}/{name}/current")
        state.withColumn("state_version", F.lit(versions[name])).write.parquet(f"{path}/{name}/{save}")
        files.write_text(spark, f"{path}/{name}/current", save)
        for old in files.children(spark, f"{path}/{name}"):
            if old.startswith("save-") and old not in (save, last):
                files.drop(spark, f"{path}/{name}/{old}")


def readable(state: DataFrame) -> bool:
    """Whether every row and column can be read."""
    try:
        state.agg(F.sum(F.xxhash64(*state.columns).bitwiseAND(1))).first()
    except (PySparkException, Py4JJavaError):
        return False
    return True


def load_state(spark: SparkSession, path: str, versions: dict[str, int]) -> dict[str, DataFrame]:
    """The models whose saved version is the one wanted. A missing one, one that cannot be read to its end, or one of another form is left out and blocks no other."""
    found = {}
    for name, version in versions.items():
        try:
            save = files.read_text(spark, f"{path}/{name}/current")
            state = None if save is None else spark.read.parquet(f"{path}/{name}/{save}")
        except (PySparkException, Py4JJavaError, UnicodeDecodeError):
            continue
        if state is None:
            continue
        if "state_version" in state.columns and readable(state) and state.where(F.col("state_version") != version).limit(1).count() == 0:
            found[name] = state.drop("state_version")
    return found
