"""Checks of what a pattern found, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Ids from here on belong to companies.
COMPANY_FROM = 50_000_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def rut(value: Column) -> Column:
    """A natural person's id with the right check character: weights 2 to 7 from the right, modulo 11."""

    def check(compact: Column) -> Column:
        body = F.substring(compact, F.lit(1), F.length(compact) - 1)
        weighted = F.aggregate(
            F.sequence(F.lit(1), F.length(body)),
            F.lit(0),
            lambda acc, i: acc + F.try_element_at(F.split(F.reverse(body), ""), i).cast("int") * (F.pmod(i - 1, F.lit(6)) + 2),
        )
        expected = F.element_at(F.split(F.lit("0,K,9,8,7,6,5,4,3,2,1"), ","), F.pmod(weighted, F.lit(11)) + 1)
        person = body.try_cast("long") < COMPANY_FROM
        return F.when(F.length(compact) < 8, False).otherwise(F.coalesce(person & (F.upper(F.right(compact, F.lit(1))) == expected), F.lit(False)))

    return let(F.regexp_replace(value, "[^0-9kK]", ""), check)


def luhn(value: Column) -> Column:
    return let(_digits(value), lambda d: (F.length(d) >= 13) & F.call_function("luhn_check", d))


def phone(value: Column) -> Column:
    """Not two years, not a case number, not over two lines; with the country's code always."""
    digits = _digits(value)
    year = r"(?:19|20)\d\d"
    return (
        F.when(digits.startswith("56") & (F.length(digits) > 9), True)
        .when(F.btrim(value, F.lit(" \t\n\r\x0b\f")).contains("\n"), False)
        .when(digits.rlike(f"^{year}{year}$"), False)
        .otherwise(~value.rlike(r"(?U)^\s*\d{4}-\d{4}\s*$"))
    )


def plate(value: Column) -> Column:
    return ~F.regexp_replace(F.upper(value), "[^A-Z0-9]", "").startswith("DE")


def date(value: Column) -> Column:
    """A day of the calendar from 1900 to 2100 (two digits: from 2000); in words, a day from 1 to 31."""
    part = lambda k: F.regexp_extract(value, r"(?U)^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\s*$", k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    real = F.try_to_date(F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd").isNotNull()
    day = F.regexp_extract(value, r"(?iU)^\s*(\d{1,2})\s+de\s+", 1)
    return F.when(part(1) != "", F.length(part(3)).isin(2, 4) & year.try_cast("int").between(1900, 2100) & real).otherwise((day == "") | day.try_cast("int").between(1, 31))


CHECKS = {"rut": rut, "luhn": luhn, "phone": phone, "plate": plate, "date": date}
