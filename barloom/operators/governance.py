"""Hashes, fingerprints, manifests and the immutable inference lock."""

from __future__ import annotations

import hashlib
import json
import logging
import platform
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def object_hash(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, dates as text."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str, hashes: bool = True) -> DataFrame:
    """(path, length, modified, sha256) of the files below path, hashed where they lie."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return t.select("path", "length", F.col("modificationTime").alias("modified"), (F.sha2("content", 256) if hashes else F.lit(None).cast("string")).alias("sha256"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest): the same for the same rows in any order and partitioning. Two 64-bit hashes of each row, summed and xored."""
    cols = sorted(columns or df.columns)
    h = df.select(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(31), *cols).alias("b"))
    t = h.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("a").alias("x"), F.sum(F.pmod("b", F.lit(1 << 31))).alias("s"))
    return t.select("rows", F.sha2(F.concat_ws("|", F.lit(",".join(cols)), F.col("rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("digest"))


def ordered_fingerprint(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(rows, digest) that depends on the order too: each row's place is part of its hash. The order must be total."""
    from pyspark.sql import Window

    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return fingerprint(placed, [*columns, "_at"])


LOCK_COLUMNS = ("event_id", "symbol", "d", "score", "daily_candidate_count", "daily_rank", "daily_signal_quota", "daily_score_cutoff", "selected")


def write_lock(predictions: DataFrame, path: str) -> str:
    """Write the nine outcome-free columns and return the digest of what was written."""
    spark = predictions.sparkSession
    predictions.select(*LOCK_COLUMNS).write.mode("errorifexists").parquet(path)
    return fingerprint(spark.read.parquet(path)).first().digest


def read_lock(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The lock, or ValueError if it isn't what the digest says. Outcomes may only be joined to what this returns."""
    locked = spark.read.parquet(path)
    found = fingerprint(locked).first().digest
    if found != digest:
        raise ValueError(f"inference lock {path} has digest {found}, not {digest}")
    return locked


def git_commit(root: str | Path) -> str | None:
    try:
        return subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def is_ancestor(root: str | Path, commit: str, of: str = "HEAD") -> bool:
    return subprocess.run(["git", "-C", str(root), "merge-base", "--is-ancestor", commit, of], capture_output=True).returncode == 0


def software(spark: SparkSession) -> dict[str, str]:
    return {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version}


def write_manifest(path: str | Path, stage: str, **content) -> str:
    """JSON manifest with its own hash, which is returned."""
    body = {"stage": stage, **content}
    text = json.dumps(body | {"manifest_sha256": (digest := object_hash(body))}, indent=2, sort_keys=True, default=str)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text + "\n", encoding="utf-8")
    return digest


def logger(name: str = "barloom") -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(h)
        log.setLevel(logging.INFO)
    return log
