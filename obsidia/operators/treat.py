"""The five treatments of a value, and texts with their spans treated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ALIAS_PREFIX, ANONYMOUS, BLOCK, TREATMENTS
from ..functions.arrays import lookup
from ..functions.spans import splice

_ALNUM = r"[\p{L}\p{N}]"


def redact(value: Column) -> Column:
    """A block for each character that is no white space."""
    return F.regexp_replace(value, r"(?U)\S", BLOCK)


def anonymize(code: Column) -> Column:
    return F.concat(F.lit("["), lookup(code, ANONYMOUS, code), F.lit("]"))


def mask_partial(value: Column, code: Column) -> Column:
    """The first three letters or digits stay, and all else that is neither; at least one is hidden."""
    letters = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    visible = F.least(F.lit(3), F.greatest(letters - 1, F.lit(0)))

    def step(acc: Column, c: Column) -> Column:
        is_letter = c.rlike(_ALNUM)
        return F.struct(
            F.concat(acc["out"], F.when(is_letter & (acc["seen"] >= visible), F.lit("*")).otherwise(c)).alias("out"),
            (acc["seen"] + is_letter.cast("int")).alias("seen"),
        )

    masked = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("seen")), step)["out"]
    return F.when(code == "FIRMA", "***").when(value == "", "").otherwise(masked)


def alias_prefix(code: Column) -> Column:
    return lookup(code, ALIAS_PREFIX, F.initcap(code))


def replacement(value: Column, code: Column, treatment: str, alias: Column | None = None) -> Column:
    """What a value of a category becomes."""
    if treatment not in TREATMENTS:
        raise ValueError(f"treatment is one of {TREATMENTS}, not {treatment}")
    value = F.coalesce(value, F.lit(""))
    if treatment == "redact":
        return redact(value)
    if treatment == "anonymize":
        return anonymize(code)
    if treatment == "pseudonymize":
        first = F.concat(alias_prefix(code), F.lit("-01"))
        return first if alias is None else F.coalesce(alias, first)
    return F.lit("********") if treatment == "mask_full" else mask_partial(value, code)


def treat_spans(df: DataFrame, treatment: str = "redact", text: str = "text", spans: str = "spans", out: str = "treated", aliases: str | None = None) -> DataFrame:
    """Add the text with its spans treated; with aliases, a map from code:norm to alias."""
    from ..functions.normalize import norm

    def of(value: Column, span: Column) -> Column:
        alias = F.col(aliases)[F.concat_ws(":", span["code"], norm(value))] if aliases else None
        return replacement(value, span["code"], treatment, alias)

    return df.withColumn(out, splice(F.coalesce(F.col(text), F.lit("")), F.col(spans), of))


def apply_findings(blocks: DataFrame, found: DataFrame, treatment: str, aliases: DataFrame | None = None) -> DataFrame:
    """blocks (doc_id, location, ord, text) with the accepted and edited findings of their location treated.

    found: doc_id, location, start, end, entity_code, text, status. aliases:
    scope-free rows (doc_id, entity_code, value, alias). A block's findings are
    its own, so the lists that are gathered are bounded by its text.
    """
    from ..functions.normalize import norm

    todo = found.filter(F.col("status").isin("accepted", "edited")).withColumn("_value", norm(F.col("text")))
    if aliases is not None:
        todo = todo.join(aliases.select("doc_id", "entity_code", F.col("value").alias("_value"), "alias"), ["doc_id", "entity_code", "_value"], "left")
    else:
        todo = todo.withColumn("alias", F.lit(None).cast("string"))
    new = replacement(F.col("text"), F.col("entity_code"), treatment, F.col("alias"))
    listed = todo.groupBy("doc_id", "location").agg(F.array_sort(F.collect_list(F.struct("start", "end", new.alias("new")))).alias("_todo"))
    joined = blocks.join(listed, ["doc_id", "location"], "left")

    done = splice(F.coalesce(F.col("text"), F.lit("")), F.coalesce("_todo", F.array().cast("array<struct<start:int,end:int,new:string>>")), lambda value, span: span["new"])
    return joined.withColumn("text", F.when(F.col("_todo").isNull(), F.col("text")).otherwise(done)).select(*blocks.columns)


def stats(found: DataFrame, keys: list[str]) -> DataFrame:
    """Treated values by category: one map a document."""
    counts = found.filter(F.col("status").isin("accepted", "edited")).groupBy(*keys, "entity_code").count()
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_code", "count")))).alias("stats"), F.sum("count").alias("total"))


