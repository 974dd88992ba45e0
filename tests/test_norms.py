"""Normal forms of odd strings, without a pattern that matches at each gap of words."""

from pyspark.sql import functions as F

from obsidia.functions.normalize import norm, norm_soft, plain_norm, plain_soft


def test_normal_forms_of_odd_strings(spark):
    """F8: of the time of q_verify_leaks most went into replacing every gap by a pattern."""
    texts = ["", " ", "a", "Á b\tÇ\nñ", "--a--b  c--", "x y", "日本 áb", "A@B.cl, 12.345-6", "ß ﬁ İ", "\x00a\x7fb\x1f", "ÀÉ—ü…", "😀a😀"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "k int, t string").select("k", norm(F.col("t")).alias("h"), norm_soft(F.col("t")).alias("s"))
    assert "[^a-z0-9@]+" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.h, r.s) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == [(plain_norm(t), plain_soft(t)) for t in texts] and got[len(texts)] == (None, None)
