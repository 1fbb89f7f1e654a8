"""Small files and folders on whatever file system Spark is configured for: listing, moving, pointers, JSON artefacts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    modified: int
    is_folder: bool

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def listed(spark: SparkSession, folder: str) -> list[Entry]:
    """What a folder holds, by name; nothing if it isn't there."""
    system, place = _at(spark, folder)
    if not system.exists(place):
        return []
    return sorted((Entry(s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in system.listStatus(place)), key=lambda e: e.path)


def status(spark: SparkSession, path: str) -> Entry | None:
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    s = system.getFileStatus(place)
    return Entry(s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames; fails if the target is there."""
    system, place = _at(spark, source)
    if status(spark, target) or not system.rename(place, _at(spark, target)[1]):
        raise FileExistsError(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: written beside it, then renamed over it."""
    system, place = _at(spark, path)
    _, part = _at(spark, path + ".part")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration())
    flags = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    flags[0] = options
    context.rename(system.makeQualified(part), system.makeQualified(place), flags)


def read_text(spark: SparkSession, path: str) -> str | None:
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Metrics, calibration tables, datasheets: keys in order, so that equal values make equal files."""
    write_text(spark, path, json.dumps(value, indent=1, sort_keys=True) + "\n")


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


# Folders of versions, of which a pointer names the current one

POINTER = "_CURRENT"


def switch(spark: SparkSession, root: str, version: str) -> int:
    """Makes a version the current one, and returns its generation: one more than the last."""
    before = read_json(spark, f"{root}/{POINTER}") or {"generation": 0}
    write_json(spark, f"{root}/{POINTER}", {"version": version, "generation": before["generation"] + 1})
    return before["generation"] + 1


def current(spark: SparkSession, root: str) -> tuple[str, int] | None:
    found = read_json(spark, f"{root}/{POINTER}")
    return (f"{root}/{found['version']}", found["generation"]) if found else None


def clean(spark: SparkSession, root: str, prefix: str, keep: int = 1) -> list[str]:
    """Removes versions but for the current one and so many before it, and what broken builds left."""
    now = current(spark, root)
    versions = [e for e in listed(spark, root) if e.is_folder and e.name.startswith(prefix)]
    broken = [e for e in versions if e.name.endswith(".building")]
    old = sorted((e for e in versions if e not in broken and (not now or e.name != now[0].rsplit("/", 1)[-1])), key=lambda e: -e.modified)[max(0, keep - 1) :]
    for e in broken + old:
        remove(spark, e.path)
    return [e.name for e in broken + old]


def newest(spark: SparkSession, root: str, prefix: str) -> str | None:
    """The folder with a prefix that was changed last, leaving out those being built."""
    found = [e for e in listed(spark, root) if e.is_folder and e.name.startswith(prefix) and not e.name.endswith(".building")]
    return max(found, key=lambda e: (e.modified, e.name)).path if found else None
