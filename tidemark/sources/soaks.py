"""Recordings (soaks): their folders, metadata, edge sources in order of priority and evidence; listings go through Hadoop's
file systems, so any path that Spark reads will do. Listings are small and belong to the driver."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import lake

META = "soak_id string, label string, path string, started_at string, legacy boolean, edges_only boolean, record_books boolean, book bigint, opportunities bigint, edges bigint, pair_keys array<string>, size_bytes bigint"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(path, is folder, bytes) of what a folder holds, by name; nothing if it is not there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().toString(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p))


def content(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a small file, None if it is not there."""
    fs, p = _fs(spark, path)
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]) if fs.exists(p) else None


def files(spark: SparkSession, path: str, suffix: str = ".jsonl") -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder with the ending, by path."""
    out = []
    for name, folder, size in listed(spark, path):
        out += files(spark, name, suffix) if folder else [(name, size)] if name.endswith(suffix) else []
    return sorted(out)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def folders(spark: SparkSession, root: str, legacy_roots: list[str] = ()) -> list[tuple[str, bool]]:
    """(folder, legacy) of all recordings, by name: those of the root, and data_* folders with raw rows in legacy roots."""
    found = {p: False for p, folder, _ in listed(spark, root) if folder and _name(p) != ".cache"}
    for base in legacy_roots:
        inside = [p for p, folder, _ in listed(spark, base) if folder]
        own = [base] if _name(base).startswith("data_") and any(_name(p) == "raw" for p in inside) else [p for p in inside if _name(p).startswith("data_") and any(_name(q) == "raw" for q, f, _ in listed(spark, p) if f)]
        found |= dict.fromkeys(own, True)
    return sorted(found.items(), key=lambda x: _name(x[0]))


def edge_sources(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """Files of edge rows by priority: EDGES files, else opportunities of the scanner, else raw edges."""
    own = [p for p, folder, _ in listed(spark, path) if not folder and _name(p).startswith("EDGES_") and p.endswith(".jsonl")]
    if own:
        return own, "standardized"
    for below, kind in (("scan/opportunities", "opportunity"), ("raw/edge", "raw_edge")):
        found = [p for p, _ in files(spark, f"{path}/{below}")]
        if found:
            return found, kind
    return [], "none"


def edge_rows(spark: SparkSession, path: str) -> DataFrame:
    """Edge rows of a recording from its best source, with that source's kind."""
    found, kind = edge_sources(spark, path)
    rows = lake.edges(spark, found) if found else spark.createDataFrame([], lake.EDGE + ", _file string")
    return rows.withColumn("source", F.lit(kind))


def evidence(spark: SparkSession, path: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored raw edges of a recording if there are any, else edges derived from its books."""
    found = [p for p, _ in files(spark, f"{path}/raw/edge")]
    return lake.edges(spark, found).drop("_file") if found else derive(lake.books(spark, f"{path}/raw/book"))


def _json(spark: SparkSession, path: str) -> dict:
    raw = content(spark, path)
    if raw is None:
        return {}
    try:
        value = json.loads(raw)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def catalog(spark: SparkSession, root: str, legacy_roots: list[str] = ()) -> DataFrame:
    """META of every recording with a manifest or data, the latest first; rows are counted by Spark, recording by recording."""
    rows = []
    for path, legacy in folders(spark, root, legacy_roots):
        manifest, summary = _json(spark, f"{path}/manifest.json"), _json(spark, f"{path}/scan_summary.json")
        every = files(spark, path, "")
        of = lambda part: [p for p, _ in every if f"/{part}/" in p and p.endswith(".jsonl")]  # noqa: E731, B023
        own = [p for p, _ in every if _name(p).startswith("EDGES_")]
        kinds = {"book": of("raw/book"), "opportunities": of("scan/opportunities"), "edges": own + of("raw/edge")}
        if not manifest and not any(kinds.values()):
            continue
        count = lambda paths: spark.read.text(paths).count() if paths else 0
        n = {k: count(v) for k, v in kinds.items()}
        keys = manifest.get("pair_keys") if isinstance(manifest.get("pair_keys"), list) else list(summary["opportunities_by_pair"]) if isinstance(summary.get("opportunities_by_pair"), dict) else None
        if keys is None:
            sources = kinds["opportunities"] + kinds["edges"]
            keys = [r[0] for r in lake.edges(spark, sources).select("pair_key").filter("pair_key <> ''").distinct().collect()] if sources else []  # the pairs of one recording
        name = _name(path)
        rows.append((
            str(manifest.get("soak_id") or name), str(manifest.get("label") or name), path, str(manifest.get("started_at") or summary.get("started_at") or ""), legacy,
            bool(manifest.get("edges_only", bool(own) and not n["book"])), bool(manifest.get("record_books", n["book"] > 0)), n["book"], n["opportunities"], n["edges"], sorted(map(str, keys)), sum(s for _, s in every),
        ))
    return spark.createDataFrame(rows, META).orderBy(F.desc("started_at"), F.desc("soak_id"))


def listing(soaks: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """A page of recordings, the latest (started_at, soak_id) first, behind `after`; 1 to 100 rows."""
    if after is not None:
        soaks = soaks.filter((F.col("started_at") < after[0]) | ((F.col("started_at") == after[0]) & (F.col("soak_id") < after[1])))
    return soaks.orderBy(F.desc("started_at"), F.desc("soak_id")).limit(min(max(1, limit), 100))
