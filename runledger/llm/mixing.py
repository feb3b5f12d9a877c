"""Operator 10, mixing sources to target weights: Sainte-Lague apportionment of token blocks.

1. Sources, in code-point order with NULL last, weigh 5, 2, 1, repeating. They
   share ``ratio`` times all tokens; no target exceeds ``most`` times its
   source, and what is cut off is shared again by weight until none is above.
2. The mix is cut into equal blocks of ``block`` tokens, which go to the sources
   by highest quotients ``target / (2k + 1)``. A source's blocks go to its
   shards the same way, weighted by the tokens of each shard: integer quotas.
3. In each shard the documents stand in a seeded order, ``most`` times over. The
   shard's quota is a run of blocks that starts at a seeded block and wraps
   around, so documents are taken whole but for the ends of the run, and none
   more than ``most`` times.

Only DataFrame functions are used. Shards split a hot source: documents go to
shards by hash, ``shard_tokens`` tokens each on average, and the running sum of
a shard is the only ordered group. Quotas need a group per source over its
shards, a table ``shard_tokens`` times smaller than the tokens; the first
distribution needs one group over the sources.

Defined cases: NULL text has size 0; documents of size 0 take 0; NULL is a
source of its own; repeated rows are documents of their own; ties in a
quotient go to the first source in order, or the lowest shard; an empty table
gives an empty result; extra columns are ignored, :func:`mixed_documents`
keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, fold, kept_table

RATIO = 1.5
MOST = 2
WEIGHTS = (5, 2, 1)
BLOCK = 16
SHARD_TOKENS = 4_000_000
SEED = 17


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, ratio: float = RATIO, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    With sources in order of ``cap / weight``, those up to some place reach
    their cap and the rest share what remains by weight; the place is the first
    whose share stays below its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    everything = Window.partitionBy()
    reach = Window.orderBy((F.col("cap") / F.col("weight")), "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(order))
        .withColumn(
            "weight",
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")),
        )
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(ratio)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(reach), F.lit(0.0)))
        .withColumn("free_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(reach), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("free_weight"))
    )
    below = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    candidate = F.struct((F.col("cap") / F.col("weight")).alias("reach"), F.col("place"), below.alias("level"))
    first = F.min(F.when(below.isNotNull(), candidate)).over(everything)
    return ranked.withColumn("first", first).select(
        "source",
        "source_size",
        "place",
        F.when(F.col("first").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("first.level") * F.col("weight")))
        .alias("target"),
    )


def apportion(cells: DataFrame, group: list[str], order: str, weight: str, seats: str, out: str) -> DataFrame:
    """Integer ``out`` per cell: ``seats`` of its group by highest ``weight / (2k + 1)``.

    Rounding with the natural divisor gives all but at most half a seat per
    cell; the few seats too many or too few are settled by comparing quotients,
    where a cell with the share p of its group can gain or lose no more than p
    of them and two.
    """
    whole = Window.partitionBy(*group)
    cells = cells.withColumn("__all", F.sum(weight).over(whole).cast("double"))
    near = F.when(F.col("__all") > 0, F.floor(F.col(seats) * F.col(weight) / F.col("__all") + 0.5)).otherwise(0)
    cells = cells.withColumn("__q", near.cast("long")).withColumn("__off", (F.col(seats) - F.sum("__q").over(whole)).cast("long"))
    span = F.ceil(F.abs("__off") * F.col(weight) / F.col("__all")).cast("long") + 2
    steps = (
        cells.where((F.col("__off") != 0) & (F.col("__all") > 0) & (F.col(weight) > 0))
        .withColumn("__step", F.explode(F.sequence(F.lit(1).cast("long"), span)))
        # A step up wins quotient number q + step; a step down gives back number q - step + 1.
        .withColumn("__k", F.when(F.col("__off") > 0, F.col("__q") + F.col("__step") - 1).otherwise(F.col("__q") - F.col("__step")))
        .where(F.col("__k") >= 0)
        .withColumn("__quotient", F.col(weight) / (2 * F.col("__k") + 1))
    )
    up = F.col("__off") > 0
    ranked = steps.withColumn(
        "__rank",
        F.row_number().over(
            Window.partitionBy(*group).orderBy(
                F.when(up, -F.col("__quotient")).otherwise(F.col("__quotient")),
                F.when(up, F.col(order)).otherwise(-F.col(order)),
                "__step",
            )
        ),
    ).where(F.col("__rank") <= F.abs("__off"))
    change = ranked.groupBy(*group, order).agg(F.sum(F.signum("__off")).cast("long").alias("__change"))
    return (
        cells.join(change, [*group, order], "left")
        .withColumn(out, F.col("__q") + F.coalesce("__change", F.lit(0)))
        .drop("__all", "__q", "__off", "__change")
    )


def _covered(at: Column, size: Column, start: Column, length: Column) -> Column:
    """Tokens that [at, at + size) shares with [start, start + length)."""
    return F.greatest(F.lit(0), F.least(at + size, start + length) - F.greatest(at, start))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Adds host, size, and the numbers that place a document: __shard, __order, __text.

    Rows without an id are placed by their text, so they do not share one shard.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return (
        docs.withColumn("__host", fold("source"))
        .withColumn("__size", words_in("text"))
        .withColumn("__shard", F.xxhash64(doc_id, F.lit(seed)))
        .withColumn("__order", F.xxhash64(doc_id, F.lit(seed + 2)))
        .withColumn("__text", F.xxhash64("text"))
    )


def _quotas(sizes: DataFrame, ratio: float, most: int, weights, block: int, shard_tokens: int, seed: int) -> tuple[DataFrame, int]:
    """Per host and shard its run of tokens (start, length), its source's target; and the number of shards."""
    total = sizes.agg(F.sum("__size")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    per_shard = (
        sizes.groupBy(F.col("__host").alias("host"), F.pmod("__shard", F.lit(shards)).alias("shard"))
        .agg(F.first("source").alias("source"), F.sum("__size").alias("shard_size"))
    )
    targets = source_targets(
        per_shard.groupBy("host").agg(F.first("source").alias("source"), F.sum("shard_size").alias("source_size")).select("source", "source_size"),
        ratio, most, weights,
    )
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    of_sources = apportion(
        targets.withColumn("blocks", blocks).withColumn("all", F.lit(0)), ["all"], "place", "target", "blocks", "quota"
    ).select(fold("source").alias("host"), "source_size", "target", "quota")
    cells = apportion(
        per_shard.select("host", "shard", "shard_size").join(of_sources, "host"), ["host"], "shard", "shard_size", "quota", "shard_quota"
    )
    ring = F.col("shard_size") * most
    places = F.greatest(F.lit(1), F.floor(ring / block))
    start = F.when(ring > 0, F.pmod(F.xxhash64("host", "shard", F.lit(seed + 1)), places) * block).otherwise(0)
    return kept_table(
        cells.withColumn("length", F.least(F.col("shard_quota") * block, ring)).withColumn("start", start)
        .select("host", "shard", "shard_size", "source_size", "target", "length", "start"),
        "mix-quotas",
    ), shards


def _taken(rows: DataFrame, quotas: DataFrame, shards: int, most: int) -> DataFrame:
    """Adds the quota's columns and ``passes``: per copy the spans [from, upto) of words that the mix takes."""
    rows = rows.withColumn("__shard", F.pmod("__shard", F.lit(shards)))
    order = Window.partitionBy("__host", "__shard").orderBy("__order", "doc_id", "__size", "__text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__at", F.sum("__size").over(order) - F.col("__size")).join(
        quotas, (F.col("__host") == F.col("host")) & (F.col("__shard") == F.col("shard"))
    )
    size, ring = F.col("__size"), F.col("shard_size") * most

    def spans(copy: int) -> list[Column]:
        at = F.col("__at") + copy * F.col("shard_size")
        found = []
        for turn in (0, 1):  # the run, and the same run one ring earlier, for its part past the end
            start = F.col("start") - turn * ring
            taken = _covered(at, size, start, F.col("length"))
            begin = F.greatest(at, start) - at
            found.append(
                F.when(taken > 0, F.struct(F.lit(copy).alias("copy"), begin.alias("from"), (begin + taken).alias("upto")))
            )
        return found

    return placed.withColumn("passes", F.array_sort(F.array_compact(F.array(*[x for copy in range(most) for x in spans(copy)]))))


def mix(
    docs: DataFrame, ratio: float = RATIO, most: int = MOST, weights=WEIGHTS, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    rows = _sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), seed)
    sizes = kept_table(rows.drop("text"), "mix-sizes")
    quotas, shards = _quotas(sizes, ratio, most, weights, block, shard_tokens, seed)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, x: total + x["upto"] - x["from"])
    return _taken(sizes, quotas, shards, most).select(
        "doc_id", "source", F.col("__size").alias("size"), "source_size", "target", taken.alias("taken")
    )


def mixed_documents(
    docs: DataFrame, ratio: float = RATIO, most: int = MOST, weights=WEIGHTS, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: int = SEED
) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: one row for each copy of a document or part of it.

    A whole document keeps its text; of a document at an end of a run the words
    taken are joined by single spaces. ``n_chars`` follows the text.
    """
    columns = docs.columns
    sizes = kept_table(_sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), seed).select("source", "__host", "__size", "__shard"), "mix-sizes")
    quotas, shards = _quotas(sizes, ratio, most, weights, block, shard_tokens, seed)
    # The caller's own columns of these names step aside.
    renamed = {c: f"__own_{c}" for c in (*quotas.columns, "passes", "part") if c in columns}
    rows = _sized(docs.withColumnsRenamed(renamed), seed)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    taken = _taken(rows, quotas, shards, most).where(F.size("passes") > 0)
    parts = F.transform(
        F.array(*[F.lit(k) for k in range(most)]), lambda k: F.filter("passes", lambda s: s["copy"] == k)
    )
    out = taken.withColumn("part", F.explode(F.filter(parts, lambda p: F.size(p) > 0)))
    cut = F.array_join(
        F.flatten(F.transform("part", lambda s: F.slice(words, (s["from"] + 1).cast("int"), (s["upto"] - s["from"]).cast("int")))), " "
    )
    covered = F.aggregate("part", F.lit(0).cast("long"), lambda total, x: total + x["upto"] - x["from"])
    out = out.withColumn("text", F.when(covered == F.col("__size"), F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(renamed.get(c, c)).alias(c) for c in columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).drop("source")
