"""Monthly trip files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.contracts import FLIGHT_CODE_COLUMNS, FLIGHT_COLUMNS, FLIGHT_HEADER_FIXES
from punctual.operators.join import union_all
from punctual.operators.project import filter_date_range, filter_in, normalize_columns

_MONTH = r"(\d{4})_(\d{1,2})(?!\d)"


def expand_archives(spark: SparkSession, pattern: str, target: str) -> DataFrame:
    """Unpack zip archives, one per task, into CSV files below ``target`` (a shared folder).

    Returns one row (archive, member, bytes) per unpacked file; ``member`` is the new file's name,
    the archive's name before the member's own, so that archives whose members are named alike
    don't meet.  A target without a scheme is in the session's default file system.  The member
    is copied in chunks, so only the compressed archive is held in memory.  An archive must hold
    exactly one CSV file.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    target = whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole
    archives = spark.read.format("binaryFile").load(pattern)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(target)
        filesystem.create_dir(base, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError(f"expected one CSV inside {path}, found {members}")
                    stem = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".zip")
                    name = f"{stem}-{members[0].rsplit('/', 1)[-1]}"
                    size = 0
                    with archive.open(members[0]) as source, filesystem.open_output_stream(f"{base}/{name}") as out:
                        while chunk := source.read(1 << 20):
                            out.write(chunk)
                            size += len(chunk)
                yield pd.DataFrame({"archive": [path], "member": [name], "bytes": [size]})

    return archives.select("path", "content").mapInPandas(unpack, "archive string, member string, bytes bigint")


def read_flights(
    spark: SparkSession,
    path: str | Sequence[str],
    airlines: Sequence[str] = (),
    origins: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
    extra: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Monthly CSV files as one frame in the trip contract.

    Columns are matched by header name and read as text, then typed; the file name gives
    ``source_csv``, ``data_year`` and ``data_month``.  Text that is no number becomes null.
    Files below one path must share a header (others raise); a list of paths may differ.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_csv")
    raw = union_all([reader.csv(p).select("*", name) for p in ([path] if isinstance(path, str) else path)])
    frame = normalize_columns(raw, FLIGHT_COLUMNS, FLIGHT_HEADER_FIXES, FLIGHT_CODE_COLUMNS, "FlightDate")
    kinds = dict(FLIGHT_COLUMNS) | dict(extra)
    typed = []
    for c in frame.columns:
        kind = kinds.get(c, "string")
        if kind in ("int", "bigint"):
            typed.append(F.col(c).try_cast("double").try_cast(kind).alias(c))
        elif kind == "double":
            value = F.col(c).try_cast("double")
            typed.append(F.when(~F.isnan(value), value).alias(c))
        else:
            typed.append(F.col(c))
    frame = frame.select(
        *typed,
        F.regexp_extract("source_csv", _MONTH, 1).try_cast("int").alias("data_year"),
        F.regexp_extract("source_csv", _MONTH, 2).try_cast("int").alias("data_month"),
    )
    frame = filter_in(frame, "Reporting_Airline", [a.strip().upper() for a in airlines])
    frame = filter_in(frame, "Origin", [o.strip().upper() for o in origins])
    return filter_date_range(frame, "FlightDate", start, end)
