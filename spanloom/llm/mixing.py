"""Mixing sources to target weights: entropy balancing, with DataFrame operations only.

Wanted are document rates r >= 0 that stay as near as possible to 1, in relative entropy weighted by tokens, and give each
source its target number of tokens. The convex dual has one multiplier a source, and r = exp(multiplier of the document's
source). Gradient and curvature of the dual depend on the documents through each source's tokens alone, so these are summed
once, as whole numbers, and the Newton steps run on the sources. Rates become whole copies by systematic rounding along the
documents of a source in the order of their size, band by band (a band: sizes from one power of two to the next) from the largest
documents down; what a band takes too much or too little is made good by the rate of the next, so that a source
misses its target by about one of its smallest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Newton steps; the dual is convex, a step moves a multiplier by 1 at most, and near the solution the digits double each time.
STEPS = 60
#: Documents of one source and size that are numbered in one task: so many, or this part of all rows if that is more. At most
#: ``PARTS`` groups can be larger, so the table of larger groups is bounded and broadcast.
RUN, PARTS = 20_000, 10_000


def token_count(text: Column) -> Column:
    """Number of maximal runs without separators: those that begin at the start or after a separator."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """source, source_size and target: ``share`` of all tokens by weight, none above ``most`` times its size.

    Sources take the weights in turn, by code point, null last. With sources in the order of size per weight, those before
    some place are full and the others share the rest; a source is full where its limit per weight is below that share.
    One row a source: the only windows over a whole table are over these.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.select("*", F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
                 (F.sum("source_size").over(everything) * share).alias("budget"))
    level = (F.col("budget") - F.col("full")) / F.col("open")
    s = s.withColumn("level", F.when(F.col("limit") / F.col("weight") >= level, level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def balance(goals: DataFrame) -> DataFrame:
    """goals with each source's rate: Newton on the dual, sum of tokens * exp(m) - m * target, where tokens * exp(m) is gradient and
    curvature at once. A source without tokens keeps the rate 1, one with target 0 gets rate 0."""

    def step(m: Column, _: Column) -> Column:
        tilted = F.col("source_size") * F.exp(m)
        return m + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - tilted) / tilted))

    m = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    return goals.withColumn("rate", F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("target") > 0, F.exp(m)).otherwise(F.lit(0.0)))


def _copies(place: Column, rate: Column, n: Column | int = 1) -> Column:
    """Copies that the n documents up to a place get together: the whole numbers that place * rate + 1/2 passes there."""
    return F.floor(place * rate + 0.5) - F.floor((place - n) * rate + 0.5)


def band_rates(runs: DataFrame, goals: DataFrame, most=MOST) -> DataFrame:
    """name, band, rate. One row a source holds its different sizes, which are no more than its longest document has words; the fold
    over them goes from the largest band down and carries the tokens still owed."""
    sizes = runs.groupBy("name", "band", "size").agg(F.sum("n").alias("n"), F.max(F.col("before") + F.col("n")).alias("place"))
    bands = sizes.groupBy("name", "band").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.collect_list(F.struct("size", "n", "place")).alias("sizes"))
    each = bands.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("band", "tokens", "sizes")), asc=False).alias("bands")).join(goals.select("name", "rate"), "name")

    def step(acc: Column, x: Column) -> Column:
        own = F.when(x["tokens"] == 0, F.col("rate")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("rate") + acc["owed"] / x["tokens"])))

        def taken(rate: Column) -> Column:
            tokens = F.aggregate(x["sizes"], F.lit(0).cast("long"), lambda t, z: t + z["size"] * _copies(z["place"], rate, z["n"]))
            return F.struct((acc["owed"] + F.col("rate") * x["tokens"] - tokens).alias("owed"), F.array_append(acc["rates"], F.struct(x["band"].alias("band"), rate.alias("rate"))).alias("rates"))

        return F.element_at(F.transform(F.array(own), taken), 1)

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<band:int,rate:double>>").alias("rates"))
    rates = each.select("name", F.explode(F.aggregate("bands", start, step, lambda acc: acc["rates"])).alias("x"))
    return rates.select("name", "x.band", "x.rate")


def rounded(docs: DataFrame, goals: DataFrame, s: common.Scratch, most=MOST) -> DataFrame:
    """Documents (doc_id, source, size) with whole ``copies``. Their places are found without gathering a source: documents of one source and
    size are numbered in runs of bounded length, and window sums go over the runs' counts only."""
    # A source's name may be null: the joins are on a text that isn't.
    name = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    docs, goals = docs.withColumn("name", name).drop("source"), goals.withColumn("name", name).drop("source")
    key = ["name", "size"]
    run = max(RUN, docs.count() // PARTS)
    many = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("runs", F.ceil(F.col("n") / run))
    d = docs.join(F.broadcast(many.where("runs > 1").select(*key, "runs")), key, "left")
    d = d.withColumn("run", F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("runs"))).cast("long")).drop("runs")
    runs = d.groupBy(*key, "run").agg(F.count(F.lit(1)).alias("n")).withColumn("band", F.when(F.col("size") == 0, 0).otherwise(F.length(F.bin("size"))))
    runs = s.written(runs.withColumn("before", F.sum("n").over(W.partitionBy("name", "band").orderBy("size", "run")) - F.col("n")))
    inner = F.row_number().over(W.partitionBy(*key, "run").orderBy("doc_id"))
    d = d.withColumn("inner", inner).join(runs.drop("n"), [*key, "run"])
    d = d.join(band_rates(runs, goals, most), ["name", "band"]).join(goals.select("name", "source_size", "target"), "name")
    return d.withColumn("copies", F.least(F.lit(int(most)), _copies(F.col("before") + F.col("inner"), F.col("rate"))).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of ``docs``.

    A null text has size 0, a null source is a source of its own, a null doc_id comes first among documents of its size;
    rows that repeat an id are numbered like any others (equal rows can trade places, their sum can't change). A source
    without tokens gets target 0 and takes nothing. Other columns are ignored, no rows give no rows.
    """
    with common.Scratch(docs.sparkSession, "mixing") as s:
        return s.result(_mix(docs, s, weights, share, most))


def _mix(docs: DataFrame, s: common.Scratch, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    sizes = s.written(docs.select("doc_id", "source", token_count(F.col("text")).alias("size")))
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    out = rounded(sizes, s.written(balance(goals)), s, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say (none, one or two); columns as given, whatever their names. Each distinct pair of
    id and text counts by itself; rows that repeat both come as often as their copies come to on average, rounded up."""
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")  # in one column, the given names clash with none here
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    with common.Scratch(docs.sparkSession, "mixing") as s:
        rows, names = common.numbered(given.select("doc_id", "text", F.col("row.source").alias("source")), s)
        count = _mix(rows.drop("doc_id").withColumnRenamed("doc", "doc_id"), s).groupBy(F.col("doc_id").alias("doc")).agg(F.ceil(F.sum("copies") / F.count(F.lit(1))).cast("int").alias("times"))
        rows = common.matched(given, count, names, s, "inner")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
