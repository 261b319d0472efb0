"""Which folders of a table of batches are live: a base with the sum of the batches up to some number, and later batches.

A manifest is a small file named by its version. It is written under another name and renamed, which succeeds for one
writer only, so readers see a whole manifest or none. All paths go through Spark's own file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

FOLDER = "_manifest"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    base: str = ""
    upto: int = -1


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest committed state; an empty one where nothing has been compacted."""
    versions = [int(m[1]) for m in (re.fullmatch(r"v(\d+)\.json", n) for n in _names(spark, f"{path}/{FOLDER}")) if m]
    if not versions:
        return Manifest()
    text = spark.read.text(f"{path}/{FOLDER}/v{max(versions)}.json", wholetext=True).first().value
    return Manifest(**json.loads(text))


def commit_manifest(spark: SparkSession, path: str, state: Manifest) -> None:
    """Make ``state`` the newest; raises where its version is there already."""
    files, target = _system(spark, f"{path}/{FOLDER}/v{state.version}.json")
    _, draft = _system(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    files.mkdirs(target.getParent())
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(asdict(state)).encode()))
    out.close()
    # a local file system renames over an existing file
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"version {state.version} of {path} is committed already")


def whole_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose write has ended."""
    files, _ = _system(spark, path)
    found = [int(n.removeprefix("batch_id=")) for n in _names(spark, path) if re.fullmatch(r"batch_id=\d+", n)]
    return sorted(n for n in found if files.exists(_system(spark, f"{path}/batch_id={n}/_SUCCESS")[1]))


def bases(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, path) if n.startswith("base-")]


def remove(spark: SparkSession, path: str, folders: list[str]) -> None:
    for name in folders:
        files, place = _system(spark, f"{path}/{name}")
        files.delete(place, True)
