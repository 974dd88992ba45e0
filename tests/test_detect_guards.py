"""Detection as one Arrow function: its plan, its guards and its overlaps."""

import random

from pyspark.sql import functions as F

from obsidia.functions import plain
from obsidia.functions.names import _EVIDENCE, NameFinder
from obsidia.functions.normalize import plain_canonical
from obsidia.operators.detect import TEXT_CODES, detect

BITS = "12.345.678-5|11.111.111|-1| |\n|4111 1111| 1111 1111|10.0.0.7|a@b.cl|@|(at)|arroba|www.|x.cl|FOLİO |folıo |paſaporte |AB12345|N° |2020-1|cuenta |Km 5 |Km |Sr. |DOÑA |señor |Juan |Pérez |nombre:|caratulado |con |3 de enero de 2020|31/12/1999|nacido el |fono |09-8123456|+56 9 |8765 4321|BCDF|12|.|,|(|[|e|)|٣".split("|")


def test_detection_is_one_function(spark):
    """patterns were expressions that took seconds to plan and were compiled in each row."""
    seen = detect(spark.range(3).select(F.lit("RUT 12.345.678-5").alias("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in seen and "regexp" not in seen and "lambda" not in seen


def test_guards_hold_where_patterns_match():
    rng = random.Random(3)
    for _ in range(4000):
        text = plain_canonical("".join(rng.choices(BITS, k=rng.randrange(1, 12))))
        low = plain._lowered(text)
        for d, pattern, guard in plain._GUARDED:
            assert guard(text, low) or not pattern.search(text), (d.code, text)
        for e in _EVIDENCE:
            assert e.guard(text) or not e.pattern.search(text), text


def test_overlaps_by_neighbour():
    """detect_spans() compared each span with all taken ones."""
    rng = random.Random(4)
    for _ in range(300):
        own, taken = plain.Disjoint(), []
        for _ in range(40):
            s = rng.randrange(200)
            e = s + rng.randrange(1, 12)
            hit = any(s < b and a < e for a, b, _ in taken)
            assert own.meets(s, e) == hit
            if not hit:
                own.add((s, e, "x"))
                taken.append((s, e, "x"))
        assert own.spans == sorted(taken)


def test_many_spans_in_one_text():
    assert len(plain.detect_spans("10.0.0.1 a@b.cl\n" * 20_000, TEXT_CODES, NameFinder())) == 40_000
