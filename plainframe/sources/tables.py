"""Tables that come from outside: Spark frames, pandas and Arrow frames, example files."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.diagnostics import PlainError


def is_table(x: Any) -> bool:
    return isinstance(x, DataFrame) or type(x).__module__.split(".")[0] in ("pandas", "pyarrow") and hasattr(x, "columns") and hasattr(x, "shape")


def spark_of(tables: Iterable[Any]) -> SparkSession | None:
    """The session of the Spark frames; Spark and local frames in one sentence are refused."""
    tables = list(tables)
    frames = [t for t in tables if isinstance(t, DataFrame)]
    if frames and len(frames) < len(tables):
        raise PlainError("some tables are Spark frames and some are local: turn the local ones into Spark frames first")
    return frames[0].sparkSession if frames else None


def as_dataframe(t: Any, spark: SparkSession) -> DataFrame:
    """A Spark frame as it is; a local one with NaN as missing."""
    if isinstance(t, DataFrame):
        return t
    import pyarrow as pa

    if not isinstance(t, pa.Table):
        t = pa.Table.from_pandas(t, preserve_index=False)
    df = spark.createDataFrame(t)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return df.withColumns({n: F.when(~F.isnan(quoted(n)), quoted(n)) for n in floats}) if floats else df


#: What a table's name may hold: it is a name and no path.
NAME = re.compile(r"[A-Za-z0-9_-]+")


def _above(name: str, start: str | Path) -> Path | None:
    """data/<name>.csv of this folder or the nearest above it; folders that may not be read are passed over."""
    for folder in (p := Path(start).resolve(), *p.parents):
        path = folder / "data" / f"{name}.csv"
        try:
            if path.is_file():
                return path
        except OSError:
            continue
    return None


def _fetched(address: str, name: str) -> Path:
    """A copy of <address>/<name>.csv in this process's folder for temporary files."""
    from urllib.error import URLError
    from urllib.request import urlopen

    source = f"{address.rstrip('/')}/{name}.csv"
    try:
        with urlopen(source, timeout=30) as got:
            data = got.read()
    except (URLError, OSError) as e:
        raise PlainError(f"there is no data/{name}.csv here or above, and {source} can't be read: {e}") from None
    path = Path(tempfile.mkdtemp(prefix="plainframe-")) / f"{name}.csv"
    path.write_bytes(data)
    return path


def example_table(name: str, text: Iterable[str] = (), start: str | Path = ".", spark: SparkSession | None = None, address: str | None = None) -> DataFrame:
    """data/<name>.csv of this folder or the nearest above it, or else <address>/<name>.csv.

    text: columns to read as they are written. address: where tables that are not here are
    published; PLAINFRAME_TABLES names it where no address is given. The file is read on the driver, so
    this is for example tables only; data in a store is read by spark.read.
    """
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise PlainError(f"{name!r} is no table name: letters, digits, _ and - make one, and it is neither a path nor a file name")
    import pyarrow as pa
    from pyarrow import csv

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    address, path = address or os.environ.get("PLAINFRAME_TABLES"), _above(name, start)
    if path is None and not address:
        raise PlainError(f"there is no data/{name}.csv here or above")
    path = path or _fetched(address, name)
    options = csv.ConvertOptions(null_values=["NA", ""], strings_can_be_null=True, column_types={c: pa.string() for c in text})
    return spark.createDataFrame(csv.read_csv(path, convert_options=options))
