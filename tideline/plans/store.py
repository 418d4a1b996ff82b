"""Fitted models kept in a folder of versions, from which another session can take them up.

    path/tables/<id>/<field>      the model's tables, as Parquet
    path/claims/<version>         who may publish a version
    path/versions/<version>.json  what the model consists of

A version is published by one rename, after all its tables have been written, and is never changed:
readers see all of it or nothing, and writers that meet take different numbers. A writer that dies
leaves files that no version names. The folder has to be on a file system where a rename is atomic.
"""

from __future__ import annotations

import importlib
import inspect
import json
import uuid
from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tideline.plans.scratch import file_system, freeze_at, frozen_at, parts_of, rows_of

FORMAT = 1


def _name(kind: type) -> str:
    return f"{kind.__module__}:{kind.__qualname__}"


def _find(name: str) -> type:
    module, _, kind = name.partition(":")
    found = getattr(importlib.import_module(module), kind, None)
    if not isinstance(found, type):
        raise ValueError(f"{name} is no class")
    return found


def _parameters(spec: Any) -> dict[str, Any]:
    """What a detector was made with, read from the attributes that bear its parameters' names."""
    names: dict[str, None] = {}
    for kind in type(spec).__mro__:
        if "__init__" in vars(kind):
            for p in inspect.signature(kind.__init__).parameters.values():
                if p.name != "self" and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL):
                    names[p.name] = None
    if missing := [n for n in names if not hasattr(spec, n)]:
        raise TypeError(f"{type(spec).__name__} does not keep its parameters {missing} under their names")
    return {n: getattr(spec, n) for n in names}


def _packed(value: Any, folder: str, label: str) -> Any:
    if isinstance(value, DataFrame):
        written = freeze_at(value, f"{folder}/{label}", parts_of(value))
        return {"table": f"{folder.rsplit('/', 1)[1]}/{label}", "schema": json.loads(value.schema.json()), "rows": rows_of(written), "parts": list(parts_of(value))}
    if value is None or isinstance(value, (bool, int, float, str)):
        return {"value": value}
    if isinstance(value, (list, tuple)):
        return {"items": [_packed(x, folder, f"{label}-{i}") for i, x in enumerate(value)], "tuple": isinstance(value, tuple)}
    if is_dataclass(value):
        return {"class": _name(type(value)), "fields": {f.name: _packed(getattr(value, f.name), folder, f"{label}-{f.name}") for f in fields(value)}}
    return {"class": _name(type(value)), "fields": {n: _packed(x, folder, f"{label}-{n}") for n, x in _parameters(value).items()}}


def _unpacked(spark: SparkSession, path: str, stored: dict[str, Any]) -> Any:
    if "table" in stored:
        return frozen_at(spark, f"{path}/tables/{stored['table']}", StructType.fromJson(stored["schema"]), stored["rows"], stored["parts"])
    if "value" in stored:
        return stored["value"]
    if "items" in stored:
        items = [_unpacked(spark, path, x) for x in stored["items"]]
        return tuple(items) if stored["tuple"] else items
    return _find(stored["class"])(**{n: _unpacked(spark, path, x) for n, x in stored["fields"].items()})


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    files, place = file_system(spark, f"{path}/versions")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def save(model: Any, path: str, spark: SparkSession | None = None) -> int:
    """Publish a fitted scaler, detector or forecaster below ``path``; returns its version."""
    spark = spark or SparkSession.getActiveSession()
    path = path.rstrip("/")
    folder = f"{path}/tables/{uuid.uuid4().hex}"
    text = json.dumps({"format": FORMAT, "model": _packed(model, folder, "model")}, indent=1)
    files, draft = file_system(spark, f"{folder}/manifest.json")
    files.mkdirs(draft.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    version = max(versions(spark, path), default=0) + 1
    for kind in ("claims", "versions"):
        files.mkdirs(file_system(spark, f"{path}/{kind}")[1])
    while not files.createNewFile(file_system(spark, f"{path}/claims/{version:010d}")[1]):
        version += 1
    if not files.rename(draft, file_system(spark, f"{path}/versions/{version:010d}.json")[1]):
        raise OSError(f"version {version} could not be published below {path}")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Any:
    """The model of a version, by default of the last one."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no version {'' if version is None else version} below {path}; there are {known}")
    files, place = file_system(spark, f"{path}/versions/{version or known[-1]:010d}.json")
    source = files.open(place)
    text = bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)).decode()
    source.close()
    stored = json.loads(text)
    if stored["format"] != FORMAT:
        raise ValueError(f"format {stored['format']} of {place.toString()} is unknown here")
    return _unpacked(spark, path, stored["model"])
