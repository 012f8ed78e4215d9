"""Writing the parts of a digest: all of them or none, under names that fit, replacing what an earlier run of the same kind wrote."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ".parts.json"


def part_names(project: str, parts: int, first: str = "", last: str = "", room: int = 120, filters: tuple[str, ...] = ()) -> list[str]:
    """``project first to last (filters) part k of n.txt``; characters that file systems refuse are dropped and the project is shortened to fit."""
    safe = re.sub(r'[\\/:*?"<>|\x00-\x1f\s]+', " ", project).strip(" .") or "digest"
    span = f" {first} to {last}" if first and last else ""
    told = [re.sub(r'[\\/:*?"<>|\x00-\x1f\s]+', " ", f).strip() for f in filters]
    span += f" ({', '.join(told)})" if any(told) else ""
    tails = [f"{span} part {k} of {parts}.txt" if parts > 1 else f"{span}.txt" for k in range(1, parts + 1)]
    return [safe[: max(8, room - len(t))].rstrip() + t for t in tails]


def write_parts(folder: str, names: list[str], texts: list[str], kind: str = "mail") -> list[str]:
    """Writes all parts, or leaves what was there; then removes parts that this kind of run wrote before and no longer has."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    fresh = [root / f".{n}.new" for n in names]
    try:
        for path, text in zip(fresh, texts, strict=True):
            path.write_text(text, encoding="utf-8")
    except Exception:
        for path in fresh:
            path.unlink(missing_ok=True)
        raise
    moved: list[tuple[Path, Path | None]] = []
    try:
        for path, name in zip(fresh, names):
            target, aside = root / name, None
            if target.exists():
                aside = root / f".{name}.old"
                os.replace(target, aside)
            moved.append((target, aside))
            os.replace(path, target)
    except Exception:
        for target, aside in moved:
            if aside is not None and aside.exists():
                os.replace(aside, target)
            else:
                target.unlink(missing_ok=True)
        for path in fresh:
            path.unlink(missing_ok=True)
        raise
    for _, aside in moved:
        if aside is not None:
            aside.unlink(missing_ok=True)
    manifest = root / MANIFEST
    known = json.loads(manifest.read_text()) if manifest.exists() else {}
    removed = [n for n in known.get(kind, []) if n not in names and (root / n).exists()]
    for name in removed:
        (root / name).unlink()
    manifest.write_text(json.dumps(known | {kind: names}))
    return removed


def run_log(counts: dict[str, int], seconds: dict[str, float], removed: list[str], notes: list[str]) -> str:
    """The log of a run: what was counted, how long steps took, what was removed, what to know."""
    lines = [f"{name}: {n}" for name, n in counts.items()]
    lines += [f"{step}: {s:.1f} s" for step, s in seconds.items()]
    lines += [f"removed: {name}" for name in removed] + [f"note: {n}" for n in notes]
    return "\n".join(lines) + "\n"


def save_cache(rows: DataFrame, folder: str, name: str) -> str:
    """Writes ``rows`` beside what is there and then points to them; readers see the old or the new rows, never a part. ``folder`` is shared by all executors.

    The pointer is a row of its own, so that every file system with whole-file writes will do.
    """
    fresh = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    pointer = rows.sparkSession.createDataFrame([(fresh,)], "path string").withColumn("saved_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/{name}.saved")
    return fresh


def load_cache(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The rows that were saved last, or None."""
    try:
        latest = spark.read.parquet(f"{folder.rstrip('/')}/{name}.saved").agg(F.max_by("path", "saved_at")).first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return spark.read.parquet(latest)


def evicted(cache: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Rows of a cache that were used (``last_used``) within ``days`` of ``today``; rows that were never used stay."""
    return cache.where(F.col("last_used").isNull() | (F.datediff(F.lit(today).cast("date"), F.col("last_used").cast("date")) <= days))
