"""Mixing sources to target weights: DataFrame operations only.

Every document gets a hash-random key; within its source, the documents are taken in the order of
the keys. The order is never sorted as a whole: a source is cut into ranges of the key, as many as
its number of documents asks for, sums run inside a range, and the sums of the ranges before it
are added. So a source with a third of all rows is spread like any other. A source's budget is
filled by whole epochs, then by the documents of the order up to the word where it is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm.scratch import Scratch

#: sources weigh these, in the order of their names, repeating
WEIGHTS = (3, 1, 2)
#: documents in a range of keys
RANGE_ROWS = 20_000
#: a source table of at most this many rows is broadcast; a larger one is joined by shuffle
BROADCAST_SOURCES = 10_000
SEED = "mix"

WORD = r"[^\x20\x09-\x0D]++"
_WORD_WITH_SPACE = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t \\n \\v \\f \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, rows, source_size, target, budget) per source of `sized` (source, size).

    The sources share 150 % of all sizes by weight; a target stops at twice its source's size and
    the excess goes to the others by weight. Capped sources are those with the smallest size per
    weight, so running sums in that order give the shares at once; whole numbers until the last
    division. One row per source passes through one task.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    ).cast("decimal(38,0)")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    size = F.col("source_size").cast("decimal(20,0)")
    shares = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("decimal(10,0)"))
        # twice the shared amount and twice the caps, to stay with whole numbers
        .withColumn("share", 3 * F.sum(size).over(everything))
        .withColumn("cap", 4 * size)
        .withColumn(
            "before",
            F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn(
            "left_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
        )
        .withColumn(
            "capped",
            F.col("cap") * F.col("left_weight") <= (F.col("share") - F.col("before")) * F.col("weight"),
        )
    )
    capped = F.when(F.col("capped"), F.col("cap")).otherwise(0)
    free = F.when(F.col("capped"), 0).otherwise(F.col("weight"))
    rest = (F.col("share") - F.sum(capped).over(everything)).cast("double")
    target = F.when(F.col("capped"), (2 * F.col("source_size")).cast("double")).otherwise(
        F.col("weight").cast("double") * rest / (2 * F.sum(free).over(everything)).cast("double")
    )
    return shares.withColumn("target", target).select(
        "source",
        "rows",
        "source_size",
        "target",
        F.floor(F.col("target") + 0.5).cast("long").alias("budget"),
    )


def _with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """`df` with the columns of its source's row; a null source is a source."""
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = sources.withColumnRenamed("source", "_source")
    return df.join(
        F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")


def taken_words(
    docs: DataFrame,
    scratch: Scratch,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
    range_rows: int = RANGE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Stored tables: per row (doc_id, source, size, key, source_size, target, epochs, part, taken),
    and the sources. `part` counts the words of the last, incomplete epoch."""
    sized = scratch.store(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")
        ),
        "sized",
    )
    sources = scratch.store(source_targets(sized, weights), "sources")
    bits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("rows") / range_rows).cast("long")
    keyed = (
        _with_source(sized, sources)
        .withColumn("key", random_key(seed))
        .withColumn("range", F.shiftright(bits * ranges, 32))
    )
    in_range = (
        Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = scratch.store(
        keyed.withColumn("inner", F.coalesce(F.sum("size").over(in_range), F.lit(0))), "running"
    )
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.store(
        running.groupBy("source", "range")
        .agg(F.sum("size").alias("total"))
        .select(
            F.col("source").alias("_source"),
            F.col("range").alias("_range"),
            F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"),
        ),
        "offsets",
    )
    size, budget = F.col("size"), F.col("budget")
    whole = F.greatest("source_size", F.lit(1))
    epochs = F.floor(budget / whole).cast("long")
    start = F.col("offset") + F.col("inner")
    part = F.least(F.greatest(budget - F.col("epochs") * whole - start, F.lit(0)), size)
    result = scratch.store(
        running.join(
            offsets,
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")),
        )
        .withColumn("epochs", epochs)
        .withColumn("part", part)
        .select(
            "doc_id",
            "source",
            "size",
            "key",
            "source_size",
            "target",
            "epochs",
            "part",
            (F.col("epochs") * size + F.col("part")).alias("taken"),
        ),
        "taken",
    )
    scratch.drop(sized, running, offsets)
    return result, sources


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of `docs` (doc_id, text, source).

    Null texts have size 0; a null source is a source of its own, after all others; without any
    word all targets are 0. Rows are ordered by the md5 of seed and doc_id, then by doc_id and
    size: repeated rows may follow each other in either order, which gives the same result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    taken, _ = taken_words(docs, scratch, weights, seed)
    scratch.close(taken)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED
) -> DataFrame:
    """The mixed corpus: the rows of `docs` once for each epoch that takes them, with `epoch` from 0.

    The document at a source's budget is cut after its last word taken and its n_chars set anew,
    where that column exists. Only one row per source, where it is cut, is joined to the texts;
    rows that repeat the cut document's id and size are all cut like it.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    taken, sources = taken_words(docs, scratch, weights, seed)
    place = F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size")
    cuts = scratch.store(
        taken.groupBy("source")
        .agg(
            F.max("epochs").alias("_epochs"),
            F.max(F.when(F.col("part") > 0, F.struct(place.alias("place"), "part"))).alias("_cut"),
        ),
        "cuts",
    )
    scratch.close(cuts)
    own = F.struct(
        random_key(seed).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        F.col("_size").alias("size"),
    )
    placed = _with_source(docs.withColumn("_size", word_count(F.col("text"))), cuts).withColumn(
        "_part",
        F.when(F.col("_cut").isNull() | (own > F.col("_cut.place")), 0)
        .when(own == F.col("_cut.place"), F.col("_cut.part"))
        .otherwise(F.col("_size")),
    )
    copies = F.col("_epochs") + F.when(F.col("_part") > 0, 1).otherwise(0)
    rows = (
        placed.filter((F.col("_size") > 0) & (copies > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
        .withColumn(
            "text",
            F.when(
                (F.col("epoch") == F.col("_epochs")) & (F.col("_part") < F.col("_size")),
                F.array_join(
                    F.slice(
                        F.regexp_extract_all("text", F.lit(_WORD_WITH_SPACE), F.lit(0)),
                        F.lit(1),
                        F.col("_part").cast("int"),
                    ),
                    "",
                ),
            ).otherwise(F.col("text")),
        )
    )
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns, "epoch")


#: DuckDB
MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][place % 3 + 1] AS HUGEINT) AS weight, CAST(source_size AS HUGEINT) * 4 AS cap,
    3 * sum(CAST(source_size AS HUGEINT)) OVER () AS share
  FROM named),
filled AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY source_size / weight, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, place
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed),
judged AS (SELECT *, cap * left_weight <= (share - before) * weight AS capped FROM filled),
rest AS (
  SELECT any_value(share) - sum(CASE WHEN capped THEN cap ELSE 0 END) AS words,
    sum(CASE WHEN capped THEN 0 ELSE weight END) AS weights FROM judged),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight AS DOUBLE) * CAST(words AS DOUBLE) / CAST(2 * weights AS DOUBLE) END AS target
  FROM judged, rest),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS epochs FROM targets),
placed AS (
  SELECT d.doc_id, d.size, b.*, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source
      ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  epochs * size + least(greatest(budget - epochs * source_size - start, 0), size) AS taken
FROM placed
"""
