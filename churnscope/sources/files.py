"""Customer-file sources: CSV/Parquet uploads, pandas-style NA tokens and type inference."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnscope.functions.cleaning import NA_TOKENS, int_text, parse_text
from churnscope.operators.exact import exact_sums

INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def read_customers(spark: SparkSession, path: str, fmt: str = "csv", infer: bool = False,
                   na_tokens: Iterable[str] = NA_TOKENS, multiline: bool = False) -> DataFrame:
    """Read an uploaded customer table.

    CSV is read with a header and every column as text (each typed role is
    coerced later anyway); pandas' default NA tokens, matched exactly and
    without trimming, become null.  ``infer=True`` then types numeric-looking
    columns as pandas' reader would (see :func:`infer_types`).

    A quote inside a quoted field is doubled.  ``multiline=True`` reads quoted
    line breaks; such files cannot be split over several tasks.
    """
    if fmt == "csv":
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("escape", '"').option("multiLine", multiline).csv(path))
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}; use csv or parquet")
    tokens = list(na_tokens)
    df = df.select(*[(F.when(~F.col(f"`{f.name}`").isin(*tokens), F.col(f"`{f.name}`"))
                      if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")).alias(f.name)
                     for f in df.schema.fields])
    return infer_types(df) if infer else df


def infer_types(df: DataFrame, cols: Iterable[str] | None = None, with_means: bool = False):
    """Type text columns whose every non-null value is a number.

    One global aggregate counts, per text column, the non-null values that
    do not parse and those that are not plain integers (partial counts per
    task, one tiny merge); the decision is a handful of numbers on the driver.
    A numeric column becomes ``bigint`` when all values are integers and none
    is missing, else ``double`` (as pandas makes an integer column with gaps
    a float column).

    ``with_means=True`` also returns each numeric column's mean, computed in
    the same pass (a column is numeric only when every value parses, so the
    mean of the parsed values is the column mean), for :func:`impute_mean`.
    Means come from exact sums, so they do not depend on the layout.
    """
    text_cols = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, StringType) and (cols is None or f.name in cols)]
    if not text_cols:
        return (df, {}) if with_means else df
    # Trimmed text and its parse in their own projections: one regex pass per value.
    staged = df.select(*[F.col(f"`{c}`").alias(f"raw{i}") for i, c in enumerate(text_cols)])
    staged = staged.select("*", *[int_text(F.col(f"raw{i}")).alias(f"txt{i}")
                                  for i in range(len(text_cols))])
    staged = staged.select("*", *[parse_text(F.col(f"txt{i}")).alias(f"num{i}")
                                  for i in range(len(text_cols))])
    n, bad, frac = {}, {}, {}
    for i in range(len(text_cols)):
        present = F.col(f"raw{i}").isNotNull()
        n[f"n{i}"] = present
        bad[f"bad{i}"] = present & F.col(f"num{i}").isNull()
        frac[f"frac{i}"] = present & ~F.col(f"txt{i}").rlike(INTEGER_PATTERN)
    counts = {"rows": F.lit(True), **n, **bad, **frac}
    if with_means:
        sums = {f"sum{i}": F.col(f"num{i}") for i in range(len(text_cols))}
        stats = exact_sums(staged, [], sums, counts).first()
    else:
        stats = staged.agg(*[F.count_if(c).alias(name) for name, c in counts.items()]).first()
    casts, means = {}, {}
    for i, c in enumerate(text_cols):
        n, bad, frac = stats[f"n{i}"], stats[f"bad{i}"], stats[f"frac{i}"]
        if n == 0 or bad > 0:
            continue
        parsed = parse_text(int_text(F.col(f"`{c}`")))
        casts[c] = parsed.cast("bigint") if (frac == 0 and n == stats["rows"]) else parsed
        if with_means:
            means[c] = stats[f"sum{i}"] / stats[f"sum{i}_n"]
    typed = df.withColumns(casts) if casts else df
    return (typed, means) if with_means else typed


def impute_mean(df: DataFrame, cols: Iterable[str] | None = None,
                means: dict[str, float] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with the column mean; text columns untouched.

    One aggregate computes every mean (a single row, one value per column),
    then ``fillna`` applies them in a projection.  NaN counts as missing.  An
    integer column with missing values becomes ``double`` (as pandas has it);
    one without keeps its type, as does a column with no value at all.
    ``means`` supplies means already computed (``infer_types(...,
    with_means=True)``), for columns that need no aggregate then.
    """
    numeric = {f.name: f.dataType.typeName() for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")
               and (cols is None or f.name in cols)}
    means = {c: float(v) for c, v in (means or {}).items() if v is not None and c in numeric}
    todo = [c for c in numeric if c not in means]
    gaps = set()
    if todo:
        values = {i: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for i, c in enumerate(todo)}
        stats = exact_sums(df, [], {f"sum{i}": v for i, v in values.items()},
                           {f"gaps{i}": v.isNull() for i, v in values.items()}).first()
        means |= {c: stats[f"sum{i}"] / stats[f"sum{i}_n"] for i, c in enumerate(todo) if stats[f"sum{i}_n"]}
        gaps = {c for i, c in enumerate(todo) if stats[f"gaps{i}"]}
    fractional = ("double", "float", "decimal")
    widened = [c for c in means if c in gaps and numeric[c] not in fractional]
    if widened:
        df = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in widened})
    fill = {c: v for c, v in means.items() if numeric[c] in fractional or c in widened}
    return df.fillna(fill) if fill else df
