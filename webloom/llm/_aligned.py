"""Marking rows of an unchanged input by what an earlier pass recorded for their partition, without a shuffle.

An earlier pass over the same DataFrame recorded (part, h) for its rows: spark_partition_id() and a hash of the row.
Later some of these are flagged. The flags are written to the shared folder by partition, and each task of a second pass
reads its own partition's. spark_partition_id() as a column of its own counts the partitions of the scan, also
inside a union; as an argument of the function it would count the task's. A row that
isn't on record for its partition is marked UNKNOWN, and the caller looks it up by a join.

pinned() sees to it that each pass finds the same rows in the same partitions, also after a loss: what isn't a plain
scan of files is written to the shared folder first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize, new_table_path

CLEAR, FLAGGED, UNKNOWN = 0, 1, 2
_PLAIN = re.compile(r"^[\s*()\d:+|-]*(?:Project|Filter|FileScan|BatchScan|ColumnarToRow|Scan parquet|WholeStageCodegen|InputAdapter)\b")


def pinned(df: DataFrame) -> DataFrame:
    """df, or a written copy of it if it is more than a scan of files."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if all(_PLAIN.match(line) for line in plan.splitlines() if line.strip()):
        return df
    names = df.columns
    return materialize(df.toDF(*[f"wl_{i}" for i in range(len(names))]), "input").toDF(*names)  # names may clash


def by_part(batches: Iterator[pd.Series], read) -> Iterator[tuple[np.ndarray, object]]:
    """(hashes, what read(part) gives) of batches of (hash, part)."""
    held: dict[int, object] = {}
    for h, part in batches:
        p = int(part.iloc[0]) if len(part) else -1
        if p not in held:
            held = {p: read(p)}
        yield h.to_numpy(np.int64, na_value=0), held[p]


def read_part(base: str, part: int, columns: list[str]):
    """The rows on record for a partition, None where there are none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{base}/part={part}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return ds.dataset(path, filesystem=store, format="parquet").to_table(columns=columns)


def _read(base: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; whether each is flagged) on record for a partition."""
    rows = read_part(base, part, ["h", "flag"])
    if rows is None:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h, flag = rows.column("h").to_numpy(), rows.column("flag").to_numpy()
    order = np.lexsort((flag, h))
    h, flag = h[order], flag[order]
    last = np.append(h[1:] != h[:-1], True) if len(h) else np.zeros(0, bool)  # of equal hashes, a flagged one
    return h[last], flag[last]


def marker(recorded: DataFrame):
    """A function of the hash and a column of spark_partition_id(): the mark of a row. recorded: (part, h, flag)."""
    base = new_table_path(recorded.sparkSession, "marks")
    recorded.select("part", "h", F.coalesce("flag", F.lit(False)).alias("flag")).distinct().repartition("part").write.partitionBy("part").parquet(base)

    @F.pandas_udf("int")
    def mark(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, (known, flag) in by_part(batches, lambda part: _read(base, part)):
            if not len(known):
                yield pd.Series(np.full(len(x), UNKNOWN, np.int32))
                continue
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            yield pd.Series(np.where(known[at] != x, UNKNOWN, np.where(flag[at], FLAGGED, CLEAR)).astype(np.int32))

    return mark.asNondeterministic()
