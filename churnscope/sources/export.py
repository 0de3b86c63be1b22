"""Result sinks: write any operator result as JSON or Parquet files.

Results are written by the executors in parallel; nothing passes through the
driver, however large the ledger or scenario set is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def export(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
           single_file: bool = False) -> str:
    """Write ``df`` to ``path`` (``json`` records or ``parquet``).

    ``single_file=True`` is for small results only (a KPI row, a chart
    dataset): it routes the rows through one task so one file comes out.
    """
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}; use json or parquet")
    out = df.coalesce(1) if single_file else df
    getattr(out.write.mode(mode), fmt)(path)
    return path
