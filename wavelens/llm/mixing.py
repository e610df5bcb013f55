"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule of it over training time. A source's
demand up to time t is its target times the integral of its schedule up to t;
documents lie one after the other on that axis, and inverting the demand at the
place of a document gives its training position. A range sort by position is
the order of training."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, growing, join_unique, partitions, prefix, row_hash

#: White space (fixed values) as a Java pattern, and the most often that a document is taken.
WORD_GAP, REPEATS = "[\\x20\\x09-\\x0D]+", 3
#: Documents of a source in one stretch of its demand axis, about.
STRETCH = 2_000


@dataclass(frozen=True)
class Curriculum:
    """slopes: how each weight class changes over training, cycled over the
    sources in order; the schedule is 1 + slope * (2 t - 1) for t from 0 to 1,
    so slope 0 is constant, 1 rises from nothing, -1 falls to nothing."""

    weights: tuple[int, ...] = (1, 2, 3)
    slopes: tuple[float, ...] = field(default=(0.0, 0.5, -0.5))
    repeats: int = REPEATS
    seed: int = 11


def _order(doc_id: Column, no_id: Column, seed: int) -> Column:
    """A 32-bit hash of (doc_id, or no_id where that is null, and seed): the place
    of a document in its source."""
    text = F.concat(F.coalesce(doc_id.cast("string"), no_id.cast("string")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _position(share: Column, slope: Column) -> Column:
    """The time at which the integral of the schedule, t + slope (t^2 - t), is `share`."""
    linear = 1 - slope
    return F.when(slope == 0, share).otherwise(2 * share / F.greatest(F.lit(1e-300), linear + F.sqrt(F.greatest(F.lit(0.0), linear * linear + 4 * slope * share))))


def source_targets(sizes: DataFrame, curriculum: Curriculum = Curriculum()) -> DataFrame:
    """source, source_size, weight, slope, target of each source from (source,
    size). Sources by code point, null last, get the weights in turn and share
    all words by weight; a target stops at `repeats` times its source's size and
    the excess is shared again by weight, until none is above. The sources that
    stop are those of the smallest ratio of stop to weight, so that running sums
    in that order settle it at once."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn") % len(values) + 1).cast("int"))
    per = per.withColumn("turn", turn).withColumn("weight", pick(curriculum.weights)).withColumn("slope", pick(curriculum.slopes))
    stop = F.col("source_size") * curriculum.repeats
    everything = Window.partitionBy()
    earlier = Window.orderBy(stop / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    per = per.withColumn("left_size", F.col("all_size") - F.coalesce(F.sum(stop).over(earlier), F.lit(0))).withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    # Stopped: the level that the sources from here on would share lies above the own stop.
    per = per.withColumn("stopped", stop * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    free_size = F.col("all_size") - F.coalesce(F.sum(F.when(F.col("stopped"), stop)).over(everything), F.lit(0))
    free_weight = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everything)
    target = F.when(F.col("stopped"), stop.cast("double")).otherwise(F.col("weight") * free_size.cast("double") / free_weight)
    return per.select("source", "source_size", "weight", "slope", target.alias("target"))


def mix(spark: SparkSession, docs: DataFrame, curriculum: Curriculum = Curriculum(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row, range-sorted by training position: doc_id, size
    (words; null text: 0), source, source_size, target (of its source), taken
    (words that the mix takes, repeats counted), copies (times that it starts),
    last_words (words of its last copy), position (training time from 0 to 1 at
    which its first copy starts, null if none does) and turn (from 1, place in
    the order of position, hash and doc_id; documents that are not taken come last).

    A source's documents follow each other in an order by seeded hash (then
    doc_id, then text hash; full repeats of a row in any order, as they are
    alike), again from the start after each round, until the target in whole
    words is reached; the last document is cut there, so taken words equal the
    target, rounded. No document is taken more than `repeats` times. A source of
    empty texts has target 0. Reruns agree. The running sums that place
    documents are taken in stretches of the hash range, so a large source is
    many tasks. Nulls in source are a source of their own; an empty table gives
    an empty result; other columns are not read."""
    scratch = Scratch(spark, "mix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    inner = F.regexp_replace(text, f"^{WORD_GAP}|{WORD_GAP}$", "")
    size = F.when(inner == "", 0).otherwise(F.size(F.split(inner, WORD_GAP))).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("h2"))
    src = scratch.write(src.withColumn("h", _order(F.col("doc_id"), F.col("h2"), curriculum.seed)), "sizes")
    targets = scratch.write(source_targets(src, curriculum), "targets")
    total = src.count()
    stretches = max(1, min(1 << 20, -(-total // STRETCH)))
    # Stretches are equal ranges of the hash, in its order.
    src = src.withColumn("stretch", F.floor(F.col("h") * F.lit(stretches) / F.lit(1 << 32)).cast("long"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("stretch")) - F.col("words")
    bases = src.groupBy("source", "stretch").agg(F.sum("size").alias("words"), F.count("*").alias("weight")).withColumn("base", before).drop("words")
    key = ["_s", "stretch"]
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s")
    plan = bases.join(targets.drop("weight").withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).select(named, "stretch", "base", "weight", "source_size", "slope", "target")
    plan = scratch.write(plan, "plan")
    placed = join_unique(src.select("*", named), plan, key, "weight", total)
    within = F.sum("size").over(Window.partitionBy("_s", "stretch").orderBy("h", "doc_id", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    start = F.col("base") + within
    whole = F.floor(F.col("target") + 0.5).cast("long")
    placed = placed.withColumn("start", start).withColumn("budget", F.least(whole, F.col("source_size") * curriculum.repeats))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    placed = placed.withColumn("rounds", rounds).withColumn("rest", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("rounds") * F.col("source_size") - F.col("start"))))
    placed = placed.withColumn("taken", F.col("rounds") * F.col("size") + F.col("rest"))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("rounds") + (F.col("rest") > 0).cast("long")).cast("long")
    last = F.when(F.col("rest") > 0, F.col("rest")).when(F.col("rounds") > 0, F.col("size")).otherwise(0)
    share = F.col("start") / F.greatest(F.col("budget"), F.lit(1))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, _position(share, F.col("slope"))))
    placed = placed.select("doc_id", "size", "source", "source_size", "target", "taken", copies.alias("copies"), last.cast("long").alias("last_words"), "position", "slope", "start", "budget", "h", "h2")
    return _in_turn(scratch, placed)


def _in_turn(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """The rows in training order, numbered. Equal positions go on by hash, which
    spreads the documents that are not taken (they have no position)."""
    spark = scratch.spark
    order = [F.col("position").asc_nulls_last(), F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("h2")]
    parts = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # The partition is in the upper bits of this number, the place in it in the lower 33.
    parts = scratch.write(parts.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33).alias("part")
    sizes = parts.groupBy(part).agg(F.count("*").alias("n"))  # as many as partitions
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    turn = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return parts.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("turn", turn).drop("at", "part", "base")


def training_order(spark: SparkSession, docs: DataFrame, curriculum: Curriculum = Curriculum(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", trim: bool = False) -> DataFrame:
    """The documents that the mix takes, one row for each copy, with the columns
    of docs, range-sorted by training position. Texts are whole, so a source goes
    over its target by less than its last document; trim: a copy that ends at the
    budget has the words up to there only.

    Null, empty and blank texts have no words and are not taken. Null sources are
    a source of their own, null ids documents like others. Rows alike in id, text
    and source are copies of their own, numbered by a hash of all columns. An
    empty table gives an empty result; other columns stay, whatever their names."""
    p = prefix(docs)
    mine = {c: f"{p}{c}" for c in ("doc_id", "h2", "source", "copies", "last_words", "size", "source_size", "slope", "start", "budget")}
    col = lambda c: F.col(f"{p}{c}")
    plan = mix(spark, docs, curriculum, id_col, text_col, source_col).where("copies > 0").select(*(F.col(c).alias(n) for c, n in mine.items()))
    plan = Scratch(spark, "order").write(plan, "plan")
    key = [f"{p}doc_id", f"{p}h2", f"{p}source"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.withColumns({f"{p}i": F.col(id_col).cast("long"), f"{p}x": F.xxhash64(text), f"{p}s": F.col(source_col).cast("string")})
    same = col("i").eqNullSafe(col("doc_id")) & (col("x") == col("h2")) & col("s").eqNullSafe(col("source"))
    if docs.groupBy(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("x"), F.col(source_col).cast("string").alias("s")).count().where("count > 1").head(1):
        # Full repeats of a row are alike: they are numbered on both sides.
        plan = plan.withColumn(f"{p}m", F.row_number().over(Window.partitionBy(*key).orderBy(f"{p}start")))
        own = own.withColumn(f"{p}n", F.row_number().over(Window.partitionBy(f"{p}i", f"{p}x", f"{p}s").orderBy(row_hash(docs))))
        same = same & (col("n") == col("m"))
    out = own.join(growing(plan), same).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), col("copies").cast("int"))))
    if trim:
        cut = (col("copy") == col("copies")) & (col("last_words") < col("size"))
        words = F.slice(F.filter(F.split(F.col(text_col), WORD_GAP), lambda x: x != ""), 1, F.greatest(F.lit(1), col("last_words").cast("int")))
        out = out.withColumn(text_col, F.when(cut, F.array_join(words, " ")).otherwise(F.col(text_col)))
    # A later copy starts a whole round of the source further on its demand axis.
    when = _position((col("start") + (col("copy") - 1) * col("source_size")) / col("budget"), col("slope")).alias(f"{p}when")
    return out.select(*docs.columns, when).repartitionByRange(partitions(spark), f"{p}when", id_col).sortWithinPartitions(f"{p}when", id_col).select(*docs.columns)
