"""Sinks: session logs, reports, and files replaced atomically."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sessions(headers: DataFrame, messages: DataFrame, path: str) -> None:
    """One text file a session, as session logs are: its header line, then its messages in order. ``headers`` has key and any
    other columns, ``messages`` has key, nth and any others. A folder is named by the key with other signs replaced, and
    a hash, so that no two keys share one. A folder a session suits an export of some sessions; tables are for all."""
    head = headers.select("key", F.lit(-1).cast("long").alias("nth"), F.to_json(F.struct(F.lit("metadata").alias("_type"), *headers.columns)).alias("value"))
    body = messages.select("key", F.col("nth").cast("long").alias("nth"), F.to_json(F.struct(*(c for c in messages.columns if c not in ("key", "nth")))).alias("value"))
    rows = head.unionByName(body).withColumn("session", F.concat(F.left(F.regexp_replace("key", r"[^A-Za-z0-9_-]", "_"), F.lit(80)), F.lit("-"), F.substring(F.md5("key"), 1, 8)))
    rows.repartition("session").sortWithinPartitions("session", "nth").select("session", "value").write.partitionBy("session").mode("overwrite").text(path)


def replace_file(path: str, text: str, expected: str | None = None) -> None:
    """Write a small driver-side file through a synced temporary one. With ``expected``, the present text must be that."""
    if expected is not None:
        present = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
        if present != expected:
            raise ValueError("the file has changed")
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def report(summary: DataFrame, title: str, limit: int = 1000) -> tuple[str, str]:
    """(JSON, Markdown) of a summary table of at most ``limit`` rows; a longer one is an error, not cut."""
    rows = [r.asDict(recursive=True) for r in summary.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError("too long for a report")
    head = summary.columns
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    table = [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(cell(r[c]) for c in head)} |" for r in rows)]
    return json.dumps({"title": title, "rows": rows}, default=str, ensure_ascii=False), "\n".join([f"# {title}", "", *table])
