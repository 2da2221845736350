"""Mixing sources to target weights by systematic sampling.

Within a source, documents are put in order of size and then of a hash of their identifiers; the prefix
sum of their expected copies, shifted by one random offset a source, is cut at the integers, and a
document is emitted once for each integer that its own interval crosses. In the order of size a step of
the sampling meets documents of all sizes, so the words taken come near the target. The offset is the one
of OFFSETS evenly spaced ones, which start at a random place, whose words come nearest; it matters for
sources of few documents.

Prefix sums are dealt out: blocks of a source's order are summed first, the sums of blocks are
accumulated, and each block then accumulates its own rows, so a hot source or one size shared by very
many documents is no single task. Sums are of fixed-point integers, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own, after all others; sources
of no words have target 0, and their documents are taken no time; repeated rows are rows of their own;
ties of size are ordered by a hash of the identifier, then by it; empty tables give empty tables; other
columns, whatever their names, are kept by `mix_rows` and left out by `mix_counts`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import WORD_CLASS, few, staged, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
OFFSETS = 16
#: Expected copies are counted in units of 1 / UNIT.
UNIT = 1 << 24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """source, source_size, target from rows (source, size); one row a source.

    The excess over `most` times a source's size is reshared by weight until no target is above: the
    sources that end at their limit are those of the least limit per weight, up to the first that stays
    below the level then left for it."""
    table = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0).cast("double"))
    table = table.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    ratio = W.orderBy(F.try_divide("limit", "weight").asc_nulls_first(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    table = table.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(share),
        "all_weight": F.sum("weight").over(everything),
        "limit_below": F.sum("limit").over(ratio.rowsBetween(W.unboundedPreceding, -1)),
        "weight_below": F.sum("weight").over(ratio.rowsBetween(W.unboundedPreceding, -1)),
    })
    level = F.try_divide(F.col("total") - F.coalesce("limit_below", F.lit(0.0)), F.col("all_weight") - F.coalesce("weight_below", F.lit(0.0)))
    table = table.withColumns({"level": level, "nth": F.row_number().over(ratio)})
    free = F.col("weight") * F.col("level") < F.col("limit")
    first_free = F.min(F.when(free, F.struct("nth", "level"))).over(everything)
    table = table.withColumn("shared", first_free["level"])
    target = F.when(F.col("weight") == 0, 0.0).otherwise(F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("shared"), F.col("limit"))))
    return table.select("source", "source_size", target.alias("target"))


def systematic_copies(rows: DataFrame, seed: str = "mix", block_rows: int = 50_000) -> DataFrame:
    """Adds `copies` to rows that have doc_id, source, size, target and expected (copies, at most a few)."""
    blocks = max(8, rows.count() // block_rows)
    rows = rows.withColumns({
        "part": F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") % blocks,
        "units": F.round(F.col("expected") * UNIT).cast("long"),
    })
    # sums of (source, size, part), then of (source, size): what lies before each in the source's order
    parts = rows.groupBy("source", "size", "part").agg(F.sum("units").alias("part_units"))
    sizes = parts.groupBy("source", "size").agg(F.sum("part_units").alias("size_units"))
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_size", F.coalesce(F.sum("size_units").over(before("source", "size")), F.lit(0))).drop("size_units")
    parts = parts.withColumn("before_part", F.coalesce(F.sum("part_units").over(before("source", "size", "part")), F.lit(0))).drop("part_units")
    starts = parts.alias("p").join(sizes.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.size") == F.col("s.size")))
    starts = starts.select(F.col("p.source").alias("b_source"), F.col("p.size").alias("b_size"), F.col("p.part").alias("b_part"), (F.col("before_size") + F.col("before_part")).alias("start"))
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("part") == F.col("b_part")))
    own = W.partitionBy("source", "size", "part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("\x00")))), 1, 6), 16, 10).cast("long")  # of 2 ** 24 units
    joined = joined.withColumn("upto", F.col("start") + F.sum("units").over(own) + offset).drop("part", "b_source", "b_size", "b_part", "start")
    joined = staged(joined, "order")
    copies = lambda shift: F.expr(f"((upto + {shift}) div {UNIT}) - ((upto + {shift} - units) div {UNIT})")
    shifts = [k * UNIT // OFFSETS for k in range(OFFSETS)]
    off = lambda k: F.abs(F.sum(F.col("size") * copies(shifts[k])) - F.max("target"))
    best = joined.groupBy("source").agg(F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(shifts[k]).alias("shift")) for k in range(OFFSETS)])).alias("best"))
    best = staged(best.select(F.col("source").alias("b_source"), F.col("best.shift").alias("shift")), "offsets")
    return joined.join(few(best, 128), F.col("source").eqNullSafe(F.col("b_source"))).withColumn("copies", copies("shift")).drop("units", "upto", "shift", "b_source")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) and copies for each row."""
    sized = staged(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD_CLASS)).cast("long").alias("size")), "sizes")
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "t_source")
    rows = sized.join(few(targets, 256), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rows = rows.withColumn("expected", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    rows = systematic_copies(rows, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """The rows of the mix with all columns of `docs`, each as often as it is taken. Rows that share an
    identifier share its copies in order of the draw, and together are emitted as often as drawn."""
    columns = docs.columns
    counts = mix_counts(docs, weights, most, seed).groupBy(F.col(key).alias("mix_key")).agg(F.collect_list("copies").alias("mix_copies"))
    counts = staged(counts, "copies")
    same = W.partitionBy(key).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in columns]))
    repeated = counts.filter(F.size("mix_copies") > 1).limit(1).count() > 0
    rows = docs.withColumn("mix_row", F.row_number().over(same) if repeated else F.lit(1))
    rows = rows.join(few(counts, 96), F.col(key).eqNullSafe(F.col("mix_key")))
    rows = rows.withColumn("mix_times", F.element_at("mix_copies", F.col("mix_row")).cast("int")).filter("mix_times > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times"))))
    return rows.select(*columns)
