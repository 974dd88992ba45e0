"""Operator 3: mix sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialise, running_totals

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times.
MAX_EPOCHS = 3
SEED = 20240611
#: Ranges of the seeded order in which a source's words are summed first.
RANGES = 4096
_KEY_BITS = 60


def seeded_order(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """60 bits of the MD5 of seed, id and text: a document's place in its source's seeded order.

    Rows without an id, or with the same one, have places by their texts; only
    rows that agree in both share a place.
    """
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, _KEY_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add target to rows (source, source_size, weight).

    Targets are level * weight, at most max_epochs * source_size, and add up to
    the sizes' total. The level starts at total / weights; each round clamps the
    sources that it lifts above their caps and shares what is left among the
    others by weight, until no more are clamped. A round is one aggregate over
    the table of sources; only the level comes to the driver.
    """
    cap = F.col("source_size") * max_epochs
    clamped, level = -1, 0.0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        total, held, share, n = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count(F.when(above, 1)),
        ).first()
        if clamped == n or not share:
            break
        clamped, level = n, (total - held) / share
        if clamped == 0 and level == 0:
            break
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target, whole, last_place, cut_place, cut_rows.

    sizes: rows (source, place, size), place from seeded_order(). A document of
    the source is taken `whole` times, and once more if its place is at most
    last_place (-1: none). That cut is where the running words, in the seeded
    order, are nearest to what whole repetitions leave of the target: words are
    summed by range of places first, and only the range that holds the cut, one
    of 4096, is sorted. Where rows that share a place, of equal texts, straddle
    the cut, cut_rows of those at cut_place (else null) are taken once more. Sums
    are taken before they are shuffled, so a source with a third of all rows is
    4096 rows a task.
    """
    shift = _KEY_BITS - RANGES.bit_length() + 1
    by_range = materialise(sizes.withColumn("range", F.shiftright("place", shift)).groupBy("source", "range").agg(F.sum("size").alias("words")))
    totals = by_range.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(totals, ["last", "source"], ["one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    sources = materialise(ranked.select("source", "source_size", weight.alias("weight")))
    plan = water_fill(sources, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a target within rounding of a whole multiple is that multiple
    whole = F.floor(ratio + 1e-12).cast("long")
    plan = materialise(plan.withColumn("whole", whole).withColumn("extra", F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0))))

    upto = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(upto.orderBy("range")), F.lit(0))
    summed = by_range.withColumn("before", before)
    cut = summed.join(plan.alias("p").select(F.col("source").alias("_s"), "extra"), F.col("_s").eqNullSafe(F.col("source")))
    cut = cut.filter((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("words"))).select(F.col("source").alias("_s"), F.col("range").alias("_r"), "before", "extra")
    inside = sizes.withColumn("range", F.shiftright("place", shift)).join(cut, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_r") == F.col("range")))
    places = inside.groupBy("source", "place", "before", "extra").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    start_of = F.col("before") + F.coalesce(F.sum("words").over(upto.orderBy("place")), F.lit(0))
    each = F.col("words") / F.col("rows")
    # a row is taken if its middle word comes before the cut
    places = places.withColumn("start", start_of).withColumn("full", F.col("start") + F.col("words") - each / 2 <= F.col("extra"))
    some = F.when(~F.col("full"), F.floor((F.col("extra") - F.col("start")) / each + 0.5)).cast("long")
    cut_at = F.when(some > 0, F.struct(F.col("place").alias("place"), some.alias("rows")))
    taken = places.groupBy("source").agg(F.max(F.when(F.col("full"), F.col("place"))).alias("inner"), F.min(cut_at).alias("cut"))
    start = cut.groupBy(F.col("_s").alias("source")).agg((F.min("_r") * F.lit(1 << shift) - 1).alias("outer"))
    cuts = start.alias("a").join(taken.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    cuts = cuts.select(F.col("a.source").alias("_s"), F.coalesce("inner", "outer").alias("place"), F.col("cut.place").alias("cut_place"), F.col("cut.rows").alias("cut_rows"))
    done = plan.alias("p").join(cuts, F.col("p.source").eqNullSafe(F.col("_s")), "left")
    # no cut range: nothing is left to take, or (by rounding) all of the source
    rest = F.when((F.col("extra") > 0) & (F.col("extra") >= F.col("source_size")), F.lit((1 << _KEY_BITS) - 1)).otherwise(-1)
    return materialise(done.select("source", "source_size", "target", "whole", F.coalesce("place", rest).cast("long").alias("last_place"), "cut_place", "cut_rows"))


def _with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (_mix_source, _mix_place and others) with the plan's columns of their source and _mix_repeats.

    Only rows at a place that straddles a cut are numbered, over all tasks; such
    rows are repeated rows, so mostly there are none.
    """
    named = plan.select(F.col("source").alias("_mix_of"), *[F.col(c).alias(f"_mix_{c}") for c in plan.columns if c != "source"])
    joined = rows.join(named, F.col("_mix_source").eqNullSafe(F.col("_mix_of"))).drop("_mix_of")
    once = F.col("_mix_whole") + F.when(F.col("_mix_place") <= F.col("_mix_last_place"), 1).otherwise(0)
    if plan.filter("cut_rows > 0").isEmpty():
        return joined.withColumn("_mix_repeats", once)
    at_cut = F.col("_mix_place").eqNullSafe(F.col("_mix_cut_place"))
    packed = joined.filter(at_cut).select("_mix_source", "_mix_place", F.struct("*").alias("_mix_row"), F.lit(1).cast("long").alias("_mix_one"))
    ranked = running_totals(packed, ["_mix_source", "_mix_place"], ["_mix_one"])
    first = materialise(ranked.groupBy(F.col("_mix_source").alias("_mix_of")).agg(F.min("before__mix_one").alias("_mix_first")))
    ranked = ranked.join(first, F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
    nth = F.col("before__mix_one") - F.col("_mix_first")
    cut = ranked.select("_mix_row.*", (F.col("_mix_row._mix_whole") + F.when(nth < F.col("_mix_row._mix_cut_rows"), 1).otherwise(0)).alias("_mix_repeats"))
    return joined.filter(~at_cut).withColumn("_mix_repeats", once).unionByName(cut)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, repeats, source.

    Only ids, sources and sizes move. Null text: size 0. Null source: a source
    of its own, last in order. Rows without an id or with the same one are told
    apart by text; repeated rows are taken one by one. A source without words
    has target 0. An empty table gives an empty one. Reruns agree: places depend
    on seed, id and text alone, and rows that share a place are alike.
    """
    sizes = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), seeded_order(F.col(doc_id), F.col(text), seed).alias("place"), count_words(F.col(text)).alias("size")))
    plan = mixing_plan(sizes, weights, max_epochs)
    done = _with_repeats(sizes.withColumnRenamed("source", "_mix_source").withColumnRenamed("place", "_mix_place"), plan)
    repeats = F.col("_mix_repeats")
    return done.select("doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.round("_mix_target", 6).alias("target"), (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"), F.col("_mix_source").alias("source"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as mix_sizes() says, with its own columns.

    Rows are decided by place and the small plan of their source, so texts stay
    in the scan's tasks when the plan is small enough for Spark to broadcast.
    Odd rows are treated as mix_sizes() treats them.
    """
    place = seeded_order(F.col(doc_id), F.col(text), seed)
    sizes = materialise(docs.select(F.col(source).alias("source"), place.alias("place"), count_words(F.col(text)).alias("size")))
    plan = mixing_plan(sizes, weights, max_epochs)
    done = _with_repeats(docs.select(*docs.columns, F.col(source).alias("_mix_source"), place.alias("_mix_place")), plan)
    return done.filter("_mix_repeats > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_repeats").cast("int")))).select(*docs.columns)
