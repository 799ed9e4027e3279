"""Configuration files with includes, and batch manifests, as rows.

A file names one target (name, dedup_file, source_dir), more under virtual_files, and other
files under includes, patterns relative to its folder.  The order is a file's own target,
then what it includes, by path, then its virtual_files; a file counts once.  These files are
small and few, so they are read on the driver.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("name", "dedup_file", "source_dir")
SCHEMA = "ordinal int, config string, name string, dedup_file string, source_dir string"


def _load(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is needed to read configuration files") from e
    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f) or {}
    if not isinstance(said, dict):
        raise ValueError(f"{path}: not a mapping")
    return said


def _target(path: str, said: dict) -> tuple[str, str, str, str]:
    missing = [k for k in FIELDS if not said.get(k)]
    if missing:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    folder = os.path.dirname(path)
    return path, said["name"], os.path.join(folder, said["dedup_file"]), os.path.join(folder, said["source_dir"])


def walk(path: str, seen: set[str]) -> Iterator[tuple[str, str, str, str]]:
    path = os.path.realpath(path)
    if path in seen:
        return
    seen.add(path)
    said = _load(path)
    more = [_target(path, v) for v in said.get("virtual_files") or []]
    if any(said.get(k) for k in FIELDS):
        yield _target(path, said)
    for pattern in said.get("includes") or []:
        for found in sorted(glob.glob(os.path.join(os.path.dirname(path), pattern), recursive=True)):
            yield from walk(found, seen)
    yield from more


def configs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All targets that the files at `paths` lead to."""
    seen: set[str] = set()
    rows = [r for p in paths for r in walk(p, seen)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A batch: files (mkv, output, name, source_dir), the common source_dir where one has none."""
    said, folder = _load(path), os.path.dirname(os.path.abspath(path))
    rows = []
    for i, f in enumerate(said.get("files") or []):
        source = f.get("source_dir") or said.get("source_dir")
        if not f.get("mkv") or not f.get("output") or not source:
            raise ValueError(f"{path}: file {i} lacks mkv, output or source_dir")
        rows.append((i, *[os.path.join(folder, x) for x in (f["mkv"], f["output"])], f.get("name") or os.path.basename(f["mkv"]), os.path.join(folder, source)))
    if not rows:
        raise ValueError(f"{path}: no files")
    return spark.createDataFrame(rows, "ordinal int, mkv string, output string, name string, source_dir string")


def write_config(path: str, name: str, dedup_file: str, source_dir: str) -> bool:
    """Writes a target's file unless it says the same already; whether it wrote."""
    text = "".join(f'{k}: "{v}"\n' for k, v in zip(FIELDS, (name, dedup_file, source_dir), strict=True))
    body = lambda t: [x for x in t.splitlines() if x.strip() and not x.startswith("#")]
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if body(f.read()) == body(text):
                return False
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".new", path)
    return True
