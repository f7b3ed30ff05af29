"""Tables loaded once: a Parquet copy and its metadata, addressed by their sources.

A copy's folder is named by a hash of the table's name, its reader's options and
the path, size and time of every source file, so a changed source has another
folder.  The copy is complete when its manifest is there: it names the data
folder, the size of each of its files, the schema and the metadata, and is put in
place by one rename after all of them.  A load checks the manifest against the
files; a torn copy (a missing or cut file, no or a broken manifest) is built anew
beside it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import files
from .tables import Dataset, metadata

MANIFEST = "manifest.json"


def address(spark: SparkSession, name: str, paths: list[str], options: dict | None = None) -> str:
    """Folder name of a table's copy."""
    found = sorted(f[1:] for path in paths for f in files.list_files(spark, path))
    text = json.dumps([name, options or {}, found], sort_keys=True)
    return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def _whole(spark: SparkSession, folder: str) -> dict | None:
    """The manifest, if all it names is there."""
    try:
        manifest = json.loads(files.read_text(spark, f"{folder}/{MANIFEST}"))
        there = {name: size for name, _, size, _ in files.list_files(spark, f"{folder}/{manifest['data']}")}
        return manifest if all(there.get(name) == size for name, size in manifest["files"]) else None
    except Exception:  # noqa: BLE001 -- no manifest, or one that can't be read: build anew
        return None


def load_cached(spark: SparkSession, name: str, paths: list[str], read: Callable[[SparkSession, list[str]], DataFrame],
                target: str, cache_dir: str, *, key_cols: list[str] = (), task: str | None = None, sector: str = "?",
                meta: dict | None = None, options: dict | None = None, use_cache: bool = True) -> tuple[Dataset, dict]:
    """The table as a :class:`Dataset` over its copy, and its metadata row.  ``read``
    is called only where there is no whole copy, or with ``use_cache=False``."""
    folder = f"{cache_dir}/{address(spark, name, paths, options)}"
    manifest = _whole(spark, folder) if use_cache else None
    if manifest is None:
        data = f"data-{uuid.uuid4().hex}"
        read(spark, paths).write.parquet(f"{folder}/{data}")
        copy = spark.read.parquet(f"{folder}/{data}")
        ds = Dataset(name, copy, target, list(key_cols), task, sector, dict(meta or {}))
        manifest = {"data": data, "schema": copy.schema.jsonValue(), "meta": metadata(ds).first().asDict(),
                    "files": [[n, size] for n, _, size, _ in files.list_files(spark, f"{folder}/{data}")]}
        files.write_text(spark, f"{folder}/{MANIFEST}", json.dumps(manifest))
    df = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{folder}/{manifest['data']}")
    row = manifest["meta"]
    return Dataset(name, df, target, list(key_cols), task or row["task"], sector, dict(meta or {})), row
