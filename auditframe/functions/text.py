"""Lines, blocks and rolling segments of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Line ends of Python's splitlines.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\u0085\\u2028\\u2029]"


def lines(artifacts: DataFrame, text: str = "text") -> DataFrame:
    """M2: one row a line with ``line_no`` from 1; a last empty line is dropped. Null text has no line."""
    parts = F.split(F.col(text), LINE_BREAKS, -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = artifacts.select(*[c for c in artifacts.columns if c != text], F.posexplode(trimmed).alias("pos", "line"))
    return rows.withColumn("line_no", (F.col("pos") + 1).cast("int")).drop("pos")


def ascii_folded(line: Column) -> Column:
    """Non-ASCII characters as ``x``: word borders then agree between regular-expression engines."""
    return F.regexp_replace(line, "[^\\x00-\\x7F]", "x")


def clamped_depth(rows: DataFrame, opens: Column, closes: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Running depth ``max(0, before + opens - closes)`` and block number; ``block`` is null outside blocks.

    The clamped sum is the plain running sum less its least value so far, where that is below 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("__open", opens.cast("long")).withColumn("__sum", F.sum(opens.cast("long") - closes.cast("long")).over(upto))
    depth = F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(upto))
    out = summed.withColumn("depth", depth).withColumn("__before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    start = (F.col("__before") == 0) & (F.col("__open") > 0)
    out = out.withColumn("__starts", F.sum(start.cast("long")).over(upto))
    inside = (F.col("__before") > 0) | (F.col("__open") > 0)
    return out.withColumn("block", F.when(inside, F.col("__starts"))).drop("__open", "__sum", "__before", "__starts")


def rolling_segments(rows: DataFrame, keys: list[str], order: str, text: str, widths: tuple[int, ...] = (2, 3), max_bytes: int = 32_768) -> DataFrame:
    """Each line joined with the next one or two, where all of them are there and the whole is short."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = None
    for width in widths:
        parts = [F.col(text), *[F.lead(text, k).over(w) for k in range(1, width)]]
        last = F.lead(order, width - 1).over(w)
        part = rows.select(*keys, F.col(order).alias("first_line"), last.alias("last_line"), F.concat_ws("\n", *parts).alias("segment"))
        part = part.filter(F.col("last_line").isNotNull() & (F.octet_length("segment") <= max_bytes)).withColumn("width", F.lit(width))
        out = part if out is None else out.unionByName(part)
    return out
