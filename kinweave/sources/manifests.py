"""Manifests beside artifacts: identity, completion, resumption."""

from __future__ import annotations

import hashlib
import json
import os
import random
import subprocess
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators.contracts import ContractError
from kinweave.sources.tables import exists, file_system, read_text, write_json


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def features_hash(names: list[str]) -> str:
    """Hash of an ordered list of features, as compact JSON."""
    return hashlib.sha256(json.dumps(list(names), separators=(",", ":")).encode()).hexdigest()


def legacy_features_hash(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def sha256_file(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_identity(path: str | os.PathLike) -> dict:
    return {"path": str(path), "bytes": os.path.getsize(path), "sha256": sha256_file(path)}


def folder_identity(path: str | os.PathLike) -> str:
    """A hash over the names and contents of all files below a folder."""
    total = hashlib.sha256()
    for f in sorted(p for p in Path(path).rglob("*") if p.is_file()):
        total.update(f"{f.relative_to(path)}\0{sha256_file(f)}\n".encode())
    return total.hexdigest()


def git_commit(path: str = ".") -> str | None:
    done = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


@dataclass
class Manifest:
    """What made an artifact, and whether it's complete."""

    name: str
    schema_version: str = "1"
    config: dict = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)
    rows: int | None = None
    metadata: dict = field(default_factory=dict)
    completion_state: str = "incomplete"

    def write(self, path: str, spark: SparkSession | None = None) -> None:
        body = self.__dict__ | {"config_hash": config_hash(self.config), "written": int(time.time())}
        write_json(body, path, spark)


def read_manifest(path: str, complete: bool = True, spark: SparkSession | None = None) -> dict:
    """A manifest; the older key ``completion`` is read as ``completion_state``.

    With a session the path may lie in any store that Spark reads.
    """
    body = json.loads(read_text(spark, path) if spark else Path(path).read_text(encoding="utf-8"))
    body.setdefault("completion_state", body.pop("completion", "incomplete"))
    if complete and body["completion_state"] != "complete":
        raise ContractError(f"{path} isn't complete")
    return body


def check_manifest(path: str, folder: str) -> dict:
    """A complete manifest whose files are exactly those of the folder, unchanged."""
    body = read_manifest(path)
    there = {p.relative_to(folder).as_posix() for p in Path(folder).rglob("*.parquet")}
    if there != set(body["files"]):
        raise ContractError(f"files differ: {sorted(there ^ set(body['files']))[:5]}")
    for name, digest in body["files"].items():
        if sha256_file(Path(folder, name)) != digest:
            raise ContractError(f"{name} was changed")
    return body


def same_identity(manifests: list[dict], keys: list[str]) -> None:
    """All manifests must agree on the given keys, where they have them."""
    for key in keys:
        values = {canonical_json(m[key]) for m in manifests if m.get(key) is not None}
        if len(values) > 1:
            raise ContractError(f"manifests differ in {key}")


def table_identity(spark: SparkSession, *paths: str) -> dict:
    """Files of the given paths with size and time of change, as a hash for each path; in any store that Spark reads."""
    out = {}
    for path in paths:
        fs, root = file_system(spark, path)
        found, files = [], fs.listFiles(root, True)
        while files.hasNext():
            f = files.next()
            found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        out[path] = config_hash(sorted(found))
    return out


def stage(spark: SparkSession, folder: str, name: str, config: dict, make: Callable[[], DataFrame], inputs: dict | None = None, after: tuple[str, ...] = ()) -> DataFrame:
    """A stage's table: read if a complete one of the same configuration and inputs is there, else made and written.

    ``inputs`` says what the stage reads (see :func:`table_identity`), ``after``
    names the stages of the folder that it reads. A stage is made again when an
    input has changed or a stage before it was made again; one of another
    configuration is refused. The manifest is written last, so a run that was
    cut off is made again.
    """
    path, manifest = f"{folder}/{name}", f"{folder}/{name}.manifest.json"
    read = {"inputs": inputs or {}, "after": {x: read_manifest(f"{folder}/{x}.manifest.json", spark=spark)["metadata"]["made"] for x in after}}
    if exists(spark, manifest):
        body = read_manifest(manifest, complete=False, spark=spark)
        if body["config_hash"] != config_hash(config):
            raise ContractError(f"{path} was made with another configuration")
        if body["completion_state"] == "complete" and body["metadata"].get("read") == read:
            return spark.read.parquet(path)
    metadata = {"read": read, "made": uuid.uuid4().hex}
    Manifest(name, config=config, metadata=metadata).write(manifest, spark)
    make().write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    Manifest(name, config=config, rows=out.count(), metadata=metadata, completion_state="complete").write(manifest, spark)
    return out


def recover(folder: str) -> list[dict]:
    """State of every stage in a folder."""
    return [{"name": m.name.removesuffix(".manifest.json"), "state": read_manifest(str(m), complete=False)["completion_state"]} for m in sorted(Path(folder).glob("*.manifest.json"))]


def seed_everything(seed: int) -> None:
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % (1 << 32))


def stage_budget(rows: int, bytes_a_row: int, memory_bytes: int, seconds_a_row: float = 0.0) -> dict:
    """Memory and time of a stage against what there is."""
    need = rows * bytes_a_row
    return {"bytes": need, "fits": need <= memory_bytes, "share": need / memory_bytes if memory_bytes else None, "seconds": rows * seconds_a_row}


def host_memory() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")


def duration(seconds: float) -> str:
    minutes, s = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes:02d}m {s:02d}s" if hours else f"{minutes}m {s:02d}s"


def environment() -> dict:
    import platform

    import pyspark

    return {"python": platform.python_version(), "spark": pyspark.__version__, "cpus": os.cpu_count(), "memory": host_memory()}


def bucket_sums(total: dict, buckets: list[dict], keys: tuple[str, ...] = ("pairs", "source_groups")) -> None:
    """The buckets of a manifest must add up to its totals."""
    for key in keys:
        if sum(b[key] for b in buckets) != total[key]:
            raise ContractError(f"buckets don't add up to {key}")
