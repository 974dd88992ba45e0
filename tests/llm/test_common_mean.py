"""Operator 9 on vectors with a large common mean."""

import numpy as np

from obsidia.llm.embeddings import MAX_TABLES, differing_after_centring, embedding_links, shape_after_centring, table_shape
from tests.llm.test_pairs import check_links


def with_mean(n, width, squared, rng):
    v = rng.standard_normal((n, width))
    v[:, 0] = 0
    v *= np.sqrt(1 - squared) / np.linalg.norm(v, axis=1)[:, None]
    v[:, 0] = np.sqrt(squared)
    return v


def test_pairs_at_the_threshold_are_found_beside_a_large_mean(spark):
    rng = np.random.default_rng(9)
    base = with_mean(400, 64, 0.85, rng)
    rows = []
    for b in base:
        # the other end of a pair at 0.952 has the same share of the mean
        away = rng.standard_normal(64)
        away[0] = 0
        rest = b.copy()
        rest[0] = 0
        away -= away @ rest / (rest @ rest) * rest
        away *= np.linalg.norm(rest) / np.linalg.norm(away)
        c = (0.952 - 0.85) / 0.15
        other = c * rest + np.sqrt(1 - c * c) * away
        other[0] = b[0]
        rows += [b.tolist(), other.tolist()]
    docs = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert check_links(list(enumerate(rows)), embedding_links(docs).collect(), 0.95) >= 0.95


def test_no_mean_needs_no_more_tables():
    v = np.random.default_rng(1).standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    bits, tables = table_shape(4000)
    assert shape_after_centring(4000, differing_after_centring(v, np.zeros(64)))[:2] == (bits, tables)


def test_keys_get_shorter_where_more_tables_would_be_needed():
    """Vectors so close to their mean that any recall has its price: in comparisons, not in tables."""
    bits, tables, radius = shape_after_centring(10**6, np.full(100, 0.4))
    assert tables <= MAX_TABLES and bits < table_shape(10**6)[0] and 1 - (1 - 0.6**bits) ** tables >= 0.97 and radius <= bits * tables


def test_pairs_are_found_at_a_mean_of_0_83(spark):
    """Pairs at 0.951 to 0.965 among vectors that share a mean of norm 0.83, with other vectors around."""
    rng = np.random.default_rng(5)
    base = with_mean(4000, 64, 0.83**2, rng)
    rows = [b.tolist() for b in base]
    for b in base[:600]:
        c = rng.uniform(0.951, 0.965)
        noise = rng.standard_normal(64)
        noise -= noise @ b * b
        rows.append((c * b + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)).tolist())
    docs = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert check_links(list(enumerate(rows)), embedding_links(docs).collect(), 0.95) >= 0.95
