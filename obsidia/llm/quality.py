"""Operator 7: quality rules of documents and of their hosts. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, materialise, words_of

#: A document with fewer words fails.
MIN_WORDS = 50
#: A document fails if more than this percentage of its words repeat.
MAX_REPEAT_PERCENT = 50
#: A document fails if it has more symbols than this share of its words.
MAX_SYMBOLS_PER_WORD = 0.5
#: ... or more repeated lines than this share of its lines.
MAX_DUP_LINES = 0.5
#: A host whose shrunken failure rate is so many deviations of the fitted prior above its mean loses its other documents too ...
HOST_DEVIATIONS = 2.0
#: ... if more than the first share of it fails; it does in any case if more than the second does.
HOST_CUT = (0.5, 0.75)
#: The prior weighs as much as so many documents at least.
MIN_STRENGTH = 10.0


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more in the text.

    Windows are hashed to 64 bits and sorted with their places, so equal ones
    are neighbours; places of repeated windows, in order, each cover three words
    less the overlap with the window before. n log n in the words of one text.
    """
    n = F.size(words)

    def covered(places: Column) -> Column:
        ordered = F.sort_array(places)
        return let(ordered, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p[i] - p[F.greatest(i - 1, F.lit(0))])).cast("long")))

    def repeats(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        hit = F.filter(
            sorted_windows,
            lambda x, i: ((i > 0) & (sorted_windows[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (sorted_windows[F.least(i + 1, last)]["h"] == x["h"])),
        )
        return let(F.transform(hit, lambda x: x["i"]), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(covered(p)))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), repeats)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(of(words))


def text_figures(text: Column) -> Column:
    """Struct of the figures of a whole text, with base_failed, and failed: by the base rules or those of symbols and lines."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    seen = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long")
    own = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))

    def judged(x: Column) -> Column:
        n = x["w"]["n_words"]
        base = (n < MIN_WORDS) | (100 * x["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
        failed = base | (x["n_symbols"] > MAX_SYMBOLS_PER_WORD * n) | (x["l"]["n_dup_lines"] > MAX_DUP_LINES * x["l"]["n_lines"])
        return F.struct(
            n.alias("n_words"),
            F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
            x["n_symbols"].alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            base.alias("base_failed"),
            failed.alias("failed"),
        )

    return let(F.struct(own.alias("w"), seen.alias("l"), symbols.alias("n_symbols")), judged)


def host_verdicts(failures: DataFrame, deviations: float = HOST_DEVIATIONS, cut: tuple[float, float] = HOST_CUT) -> DataFrame:
    """host, n_docs, n_failed, rate, host_cut, host_kept from rows (host, failed boolean).

    The prior is fitted to the hosts' own rates by moments (each host weighted
    by its documents): a beta with mean m, variance v and strength
    s = m(1-m)/v - 1, MIN_STRENGTH at least. A host's rate is (failed + s*m) / (n + s), so a host with
    few documents stays near the mean of all. Hosts go whose rate is above
    m + deviations * sqrt(v), held between the two shares of cut: a host of
    which most is sound stays however even the others are, and one of which
    almost all is junk goes even where it is a third of all rows and widens the
    prior by itself. Where all hosts have one rate, v is 0 and every host has
    the mean. A null host is a host of its own; no rows give no hosts.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    # two figures come to the driver
    m, m2 = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.sum(F.col("n_docs") * p * p) / F.sum("n_docs")).first()
    m, variance = (m or 0.0), max((m2 or 0.0) - (m or 0.0) ** 2, 1e-9)
    strength = min(max(m * (1 - m) / variance - 1, MIN_STRENGTH), 1e6)
    limit = round(min(max(m + deviations * variance**0.5, cut[0]), cut[1]), 9)
    rated = hosts.withColumn("rate", F.round((F.col("n_failed") + strength * m) / (F.col("n_docs") + strength), 9)).withColumn("host_cut", F.lit(limit))
    return rated.select("host", "n_docs", "n_failed", "rate", "host_cut", (F.col("rate") <= F.col("host_cut")).alias("host_kept"))


def quality_rules(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text", deviations: float = HOST_DEVIATIONS, cut: tuple[float, float] = HOST_CUT) -> DataFrame:
    """The verdict of each document: its own rules, and its host's.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, host, host_rate, host_kept. A document
    fails by the base rules, by too many symbols or by too many repeated lines.
    Rejected: documents that fail, and all documents of a host that
    host_verdicts() rejects, as most of it is junk.

    The figures, some 80 bytes a document, are written once; host counts are
    summed before they are shuffled, so a host with a third of all rows is one
    row a task. Verdicts go back by a join on host that Spark may broadcast by
    size or split by skew. Null text: no words, so it fails. Repeated rows are
    judged each. Null ids and sources are kept as they are, a null source is a
    host. An empty table gives an empty one.
    """
    figures = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), text_figures(F.col(text)).alias("_f")).select("doc_id", "host", "_f.*"))
    verdicts = host_verdicts(figures, deviations, cut).withColumnRenamed("host", "_host")
    joined = figures.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("failed") & F.col("host_kept")).alias("kept"),
        "host", F.col("rate").alias("host_rate"), "host_kept",
    )


def passing_documents(docs: DataFrame, host: str = "source", doc_id: str = "doc_id", text: str = "text", deviations: float = HOST_DEVIATIONS, cut: tuple[float, float] = HOST_CUT) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with their own columns.

    Rules are taken once: rows go to a table of the shared folder with their
    own verdict beside them, host counts come from its narrow columns, and the
    rows that pass are read back with the verdict of their host, so texts are
    never shuffled. Odd rows are treated as quality_rules() treats them.
    """
    own = "_verdict_failed"
    rows = materialise(docs.select(*docs.columns, text_figures(F.col(text))["failed"].alias(own)))
    verdicts = materialise(host_verdicts(rows.select(F.col(host).alias("host"), F.col(own).alias("failed")), deviations, cut))
    hosts = verdicts.filter("host_kept").select(F.col("host").alias("_verdict_host"))
    return rows.filter(~F.col(own)).join(hosts, F.col(host).eqNullSafe(F.col("_verdict_host"))).select(*docs.columns)
