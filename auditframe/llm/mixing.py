"""Mixing sources to target weights by capped water-filling, all in DataFrame operations.

Targets are min(cap, level * weight), with the one level at which they add up to the total: a source
that would exceed ``max_epochs`` times its size is held there and the rest is shared again by weight.
Each source then takes every document floor(target / size) times, and a seeded sample once more.
The last document of the sample is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Cells of the hash range of a source, for running sums over few rows.
CELLS = 65_536  # four hexadecimal digits
#: Up to so many sources their table (about 60 bytes a row) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _digest(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _cell(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size): a table with a row for each source, ordered in one window."""
    total = Window.partitionBy()
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    # Sources reach their cap in the order cap / weight; before each, what the earlier ones take is gone.
    order = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(total))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_words").cast("double") / F.col("left_weight").cast("double"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        # levels fall once one is open, so the first open one is the largest
        .withColumn("first_open", F.max(F.when(F.col("open"), F.col("level"))).over(total))
    )
    target = F.when(F.col("first_open").isNull() | (F.col("cap") < F.col("first_open") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("first_open") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Add size, source_size, target, copies, rest and taken to every document; no document is moved.

    Reading: one pass for the sizes of (source, cell), summed before the shuffle, one for the cells in
    which samples end, and one for the result, joined with one row for each source. Documents stand in
    the order of a seeded hash; the first get one more copy, and the one at which the target is
    reached gives only its first ``rest`` words, so that each source meets its target.

    Null texts and texts without words have size 0, take part and are taken with 0 words; a null
    source is a source, last in order; a source of size 0 has target 0 and no copies. Rows that
    repeat a doc_id share its decision. Columns named like an output are replaced.
    """
    made = ["size", "source_size", "target", "copies", "rest", "taken"]
    names = [c for c in docs.columns if c not in made or c in {text, source, doc_id}]
    base = docs.select(*[docs[f"`{c}`"] for c in names])
    sized = base.withColumn("__size", word_count(F.col(f"`{text}`"))).withColumn("__digest", _digest(F.col(f"`{doc_id}`"), seed))
    slim = sized.select(F.col(f"`{source}`").alias("source"), "__size", "__digest")
    cells = materialize(slim.groupBy("source", _cell(F.col("__digest")).alias("cell")).agg(F.sum("__size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    named = plan.select(F.col("source").alias("s"), "part")
    by_source = F.col("source").eqNullSafe(F.col("s"))
    running = Window.partitionBy("source")
    # The cell in which the sample ends, and in it the document; both are running sums of few rows.
    border = (
        cells.withColumn("upto", F.sum("words").over(running.orderBy("cell")))
        .join(F.broadcast(named) if _few(named) else named, by_source)
        .filter((F.col("part") > 0) & (F.col("upto") >= F.col("part")) & (F.col("upto") - F.col("words") < F.col("part")))
        .select(F.col("source").alias("s"), "cell", (F.col("part") - (F.col("upto") - F.col("words"))).alias("left"))
    )
    border = materialize(border, "mix-border")
    inside = slim.join(F.broadcast(border) if _few(border) else border, by_source & (_cell(F.col("__digest")) == F.col("cell")))
    ends = (
        inside.groupBy("source", "__digest", "left").agg(F.sum("__size").alias("words"))
        .withColumn("upto", F.sum("words").over(running.orderBy("__digest")))
        .filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        .select(F.col("source").alias("s"), F.col("__digest").alias("end"), ((F.col("left") - (F.col("upto") - F.col("words"))) / F.col("words")).alias("share"))
    )
    decided = plan.join(ends, by_source, "left").select(F.col("source").alias("__source"), "source_size", "target", "whole", "end", "share")
    decided = materialize(decided, "mix-plan")
    out = sized.join(F.broadcast(decided) if _few(decided) else decided, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    copies = F.col("whole") + F.coalesce((F.col("__digest") < F.col("end")).cast("long"), F.lit(0))
    rest = F.when(F.col("__digest") == F.col("end"), F.floor(F.col("__size") * F.col("share") + 0.5)).otherwise(0).cast("long")
    out = out.select(*[F.col(f"`{c}`") for c in names if c not in made], F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), rest.alias("rest"))
    return out.withColumn("taken", F.col("size") * F.col("copies") + F.col("rest"))


def _few(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_SOURCES


def repeat_rows(mixed: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Each row as often as ``copies`` says, and once more cut after ``rest`` words if that is not 0."""
    turns = F.sequence(F.lit(1).cast("long"), F.col("copies") + (F.col("rest") > 0).cast("long"))
    rows = mixed.filter("copies > 0 or rest > 0").withColumn("__copy", F.explode(turns))
    cut = F.col("__copy") > F.col("copies")
    words = F.split(F.col(f"`{text}`"), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])", -1)
    rows = rows.withColumn(text, F.when(cut, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("rest"), F.lit(1)).cast("int")), "")).otherwise(F.col(f"`{text}`")))
    if n_chars in mixed.columns:
        rows = rows.withColumn(n_chars, F.when(cut, F.length(F.col(f"`{text}`")).cast("long")).otherwise(F.col(f"`{n_chars}`")))
    return rows.drop("__copy")


def mix_sql(weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, docs: str = "documents") -> str:
    """The same in DuckDB SQL: table mixed: doc_id, size, source_size, target, copies, rest."""
    case = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS digest, ('0x' || substr(digest, 1, 4))::BIGINT AS cell
  FROM {docs}),
cells AS (SELECT source, cell, sum(size)::BIGINT AS words FROM sized GROUP BY source, cell),
ranked AS (
  SELECT source, sum(words)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {case} END AS weight
  FROM cells GROUP BY source),
filled AS (
  SELECT *, source_size * {max_epochs} AS cap,
    ((sum(source_size) OVER ())::BIGINT - coalesce((sum(source_size * {max_epochs}) OVER o)::BIGINT, 0))::DOUBLE
      / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER o)::BIGINT, 0))::DOUBLE AS level
  FROM ranked
  WINDOW o AS (ORDER BY (source_size * {max_epochs})::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS first_open FROM filled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
  FROM (SELECT source, source_size,
    CASE WHEN first_open IS NULL OR cap < first_open * weight THEN cap::DOUBLE ELSE first_open * weight END AS target FROM levels)),
summed AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY cell))::BIGINT AS upto FROM cells),
border AS (
  SELECT s.source, s.cell, p.target - p.whole * p.source_size - (s.upto - s.words) AS left_words
  FROM summed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
  WHERE p.target - p.whole * p.source_size > 0 AND s.upto >= p.target - p.whole * p.source_size AND s.upto - s.words < p.target - p.whole * p.source_size),
inside AS (
  SELECT d.source, d.digest, b.left_words, sum(d.size)::BIGINT AS words
  FROM sized d JOIN border b ON d.source IS NOT DISTINCT FROM b.source AND d.cell = b.cell GROUP BY d.source, d.digest, b.left_words),
run AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY digest))::BIGINT AS upto FROM inside),
ends AS (SELECT source, digest, (left_words - (upto - words)) / words AS share FROM run WHERE upto >= left_words AND upto - words < left_words),
mixed AS (
  SELECT d.*, p.source_size, p.target, p.whole + CASE WHEN d.digest < e.digest THEN 1 ELSE 0 END AS copies,
    CASE WHEN d.digest = e.digest THEN floor(d.size * e.share + 0.5) ELSE 0 END::BIGINT AS rest
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source)
"""
