"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_hash(column, seed: int):
    """A number in [0, 1) fixed by the value and the seed: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: __source, source_size, target, rate.

    sizes has one row per source (__source, source_size). The sources, by code point with null last, weigh `weights`
    in turn, and share `share` times the total. A target stops at `cap` times its source's size; the excess goes to
    the others by weight until none is above. In order of cap over weight the capped sources come first, so one
    running sum finds them: a source is capped if the level at which it would be left sharing is above its own.
    """
    by_name, all_rows = Window.orderBy(F.col("__source").asc_nulls_last()), Window.partitionBy()
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("w", F.element_at(pattern, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumns({"top": cap * F.col("source_size"), "total": share * F.sum("source_size").over(all_rows)})
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("__source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"place": F.row_number().over(order), "used": F.coalesce(F.sum("top").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all_w": F.sum("w").over(all_rows)})
    t = t.withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("gone")))
    t = t.withColumn("free", F.col("level") * F.col("w") <= F.col("top"))
    # the first source that is not capped fixes the level for itself and all after it
    t = t.withColumn("level", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(all_rows)["level"])
    target = F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("level") * F.col("w")))
    return t.select("__source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with __size, __source_size, __target and __copies: how often the mix takes the document.

    A document's rate is its source's target over its source's size; it is taken floor(rate) times, plus once more if
    its hash, seeded, is below the fraction. Null source: a source of its own, last. Null text: size 0. Null key: one
    hash for all such rows. Rows that repeat a key are taken alike. Empty table: empty result. Only one row per source
    meets in one task; the documents join these by source, which Spark broadcasts if it finds them small and else
    splits where a source is large. Columns of docs with the names of the four new ones are replaced.
    """
    rows, own = numbered(docs)
    sized = rows.withColumns({"__size": n_words(own[text]), "__source": F.col(own[source])})
    sizes = sized.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    rates = source_rates(sizes, weights, share, cap).withColumnsRenamed({"__source": "__of", "source_size": "__source_size", "target": "__target", "rate": "__rate"})
    joined = sized.join(rates, F.col("__source").eqNullSafe(F.col("__of")), "left")
    whole = F.floor("__rate")
    copies = whole + (unit_hash(F.col(own[key]), seed) < F.col("__rate") - whole).cast("long")
    new = ["__size", "__source_size", "__target"]
    carried = [F.col(c).alias(name) for name, c in own.items() if name not in (*new, "__copies")]
    return joined.select(*carried, *new, copies.cast("long").alias("__copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, whatever they are called, each document as often as `mix_plan` takes it."""
    rows, own = numbered(docs)
    names = {"source": "source", "key": "doc_id", "text": "text"}
    plan = mix_plan(rows, **options | {k: own[options.get(k, name)] for k, name in names.items()})
    copies = plan.where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return copies.select(*own.values()).toDF(*docs.columns)
