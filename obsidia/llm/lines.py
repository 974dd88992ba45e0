"""Operator 8: drop lines that a site repeats on too many of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialise

#: A line is boilerplate on a page if more than this share of the host's other pages hold it too.
MAX_RATIO = 0.1


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate_lines(docs: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, prior_pages: int = 0, copies_once: bool = False) -> DataFrame:
    """host and the hashes of its boilerplate lines, one row for each host that has any.

    A page counts once for each of its lines, trimmed; blank lines don't count.
    Of the host's other pages, the share with the line is taken: (pages with it
    - 1) / (pages - 1 + prior_pages). So a line on one page alone is never
    boilerplate, and prior_pages, imagined pages without the line, shrink the
    share on hosts with few pages. With copies_once, rows of a host with equal
    texts (by 128 bits of hash) are one page.

    Lines are counted by 64-bit hash with partial sums, so a line that a third
    of all pages hold is one row a task. A host's list has at most (mean
    distinct lines a page) / max_ratio entries and a few.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: _bare(x) != "")
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("_text"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_bare(x)))).alias("lines"))
    if copies_once:
        pages = pages.withColumn("_h1", F.xxhash64("_text")).withColumn("_h2", F.xxhash64(F.lit("second"), "_text"))
        pages = pages.groupBy("host", "_h1", "_h2").agg(F.first("lines").alias("lines"))
    # a null stands for the page itself: one pass counts pages and lines
    counted = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counted = materialise(counted)
    totals = counted.filter(F.col("line").isNull()).select(F.col("host").alias("_h"), F.col("pages").alias("total"))
    often = counted.filter(F.col("line").isNotNull() & (F.col("pages") > 1)).join(totals, F.col("host").eqNullSafe(F.col("_h")))
    often = often.filter(F.col("pages") - 1 > max_ratio * (F.col("total") - 1 + prior_pages))
    return materialise(often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boilerplate")))


def drop_site_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, prior_pages: int = 0, copies_once: bool = False, max_dropped: float | None = None) -> DataFrame:
    """docs with its hosts' boilerplate lines taken out of the text, and two counts.

    Adds n_lines (lines of the text, blank ones too; long) and n_dropped. What
    is left of a text is joined by \\n as before; a text that loses all lines is
    empty; null stays null (no lines). A null host is a host of its own. A host
    of one page loses nothing. Repeated rows are pages each; with copies_once,
    rows of a host with equal texts count as one page. With max_dropped, a page
    stays whole of whose lines the boilerplate would be a larger share: of such a page stands elsewhere too, so it is a copy with edits, not a page
    with boilerplate, and whole pages are to decide about it. An empty table
    gives an empty one.

    The lists of lines go to the pages by a join on host: they are few beside
    the pages, so Spark broadcasts them if their measured size allows; else it
    sorts, and splits hosts that hold many rows.
    """
    lists = boilerplate_lines(docs, host, text, max_ratio, prior_pages, copies_once).select(F.col("host").alias("_lines_host"), F.col("boilerplate").alias("_lines_drop"))
    joined = docs.join(lists, F.col(host).eqNullSafe(F.col("_lines_host")), "left")
    own = F.split(F.col(text), "\n", -1)
    # a page's own lines on the host's list, by hashing; the list itself is not searched for each line
    joined = joined.withColumn("_lines_own", F.when(F.col("_lines_drop").isNotNull(), F.array_intersect(F.transform(own, lambda x: F.xxhash64(_bare(x))), F.col("_lines_drop"))))
    kept = F.when(F.coalesce(F.size("_lines_own"), F.lit(0)) <= 0, own).otherwise(F.filter(own, lambda x: (_bare(x) == "") | ~F.array_contains(F.col("_lines_own"), F.xxhash64(_bare(x)))))
    done = joined.withColumn("_lines_kept", kept)
    if max_dropped is not None:
        filled = lambda lines: F.size(F.filter(lines, lambda x: _bare(x) != ""))
        copied = F.size(own) - F.size("_lines_kept") > max_dropped * filled(own)
        done = done.withColumn("_lines_kept", F.when(copied, own).otherwise(F.col("_lines_kept")))
    n = F.coalesce(F.size(own), F.lit(0)).cast("long")
    left = F.coalesce(F.size("_lines_kept"), F.lit(0)).cast("long")
    columns = [F.when(n == left, F.col(text)).otherwise(F.array_join("_lines_kept", "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(n - left).cast("long").alias("n_dropped"))
