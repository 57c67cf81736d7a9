"""Sinks: Parquet as the working format, CSV with a fixed column order, and small JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_COLUMNS = ["action", "reason", "cluster_id", "source_db", "title", "doi", "matched_with_db", "matched_with_title"]
#: Rows that a JSON document may hold; larger results are written as Parquet or JSON lines.
MAX_DOCUMENT_ROWS = 10_000


def write_log(log: DataFrame, path: str) -> None:
    """The decision log as CSV with a header, in a fixed column order."""
    log.select(*LOG_COLUMNS).write.mode("errorifexists").csv(path, header=True, quoteAll=False, escape='"')


def write_records(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A new version of a data set; a path that exists is never overwritten, as it may be the input of the plan."""
    records.write.mode("errorifexists").format(fmt).save(path)


def document(**parts: DataFrame) -> str:
    """A JSON document of small aggregates: each part a list of objects. A part above MAX_DOCUMENT_ROWS raises."""
    out = {}
    for name, df in parts.items():
        rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).limit(MAX_DOCUMENT_ROWS + 1).collect()
        if len(rows) > MAX_DOCUMENT_ROWS:
            raise ValueError(f"{name} has more than {MAX_DOCUMENT_ROWS} rows")
        out[name] = sorted((json.loads(r["j"]) for r in rows), key=lambda x: json.dumps(x, sort_keys=True))
    return json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True)
