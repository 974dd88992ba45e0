"""Spreadsheet columns whose header names a category."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm_soft

#: Words of a header, in order of precedence.
HEADERS = {
    "FOLIO": "folio expediente ingreso",
    "RUT": "rut run",
    "EMAIL": "correo email",
    "TELEFONO": "telefono fono celular",
    "DIRECCION": "domicilio direccion",
    "NOMBRE": "nombre reclamante solicitante denunciante funcionario funcionaria trabajador interesado apoderado representante apellido apellidos",
    "CUENTA_BANCARIA": "cuenta",
    "PATENTE": "patente",
    "PASAPORTE": "pasaporte",
    "IP": "ip",
    "FECHA_NACIMIENTO": "nacimiento",
    "TARJETA": "tarjeta",
    "FECHA": "fecha",
}
#: Cells that stand for nothing, and the longest header.
EMPTY = ("-", "—", "N/A", "n/a", "s/i", "S/I")
LONGEST_HEADER = 40
SCORE = 0.85
_WHITE = " \t\n\r\x0b\f "


def cell_place(location):
    """struct<sheet, col, row> of a location such as Sheet!B7; null for others."""
    part = lambda k: F.regexp_extract(location, r"^(.*)!([A-Z]{1,3})(\d+)$", k)
    return F.when(part(2) != "", F.struct(part(1).alias("sheet"), part(2).alias("col"), part(3).cast("int").alias("row")))


def column_findings(cells: DataFrame, codes: Iterable[str]) -> DataFrame:
    """doc_id, location, start, end, entity_code, text, score of cells below a telling header.

    cells: doc_id, location, text. A column's header is its first cell of at
    most 40 characters with a word of a selected category; every later cell that
    holds something is a value of it, whole but for white space at its ends. The
    header is the smallest row of a column, an aggregate that is taken in parts,
    so long columns don't come together in a task.
    """
    wanted = set(codes)
    words = F.split(norm_soft(F.col("text")), " ")
    code = F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, names.split()))), F.lit(c)) for c, names in HEADERS.items() if c in wanted], F.lit(None))
    placed = cells.select("doc_id", "location", "text", cell_place(F.col("location")).alias("_at")).filter("_at is not null").select("doc_id", "location", "text", "_at.*")
    column = ["doc_id", "sheet", "col"]
    header = F.when(F.length("text") <= LONGEST_HEADER, code)
    tops = placed.withColumn("_code", header).filter("_code is not null").groupBy(*column).agg(F.min(F.struct("row", F.col("_code").alias("code"))).alias("top"))
    value = F.btrim("text", F.lit(_WHITE))
    below = placed.join(tops, column).filter(F.col("row") > F.col("top.row")).withColumn("_value", value)
    kept = below.filter(((F.length("_value") >= 3) | ((F.col("top.code") == "NOMBRE") & (F.col("_value") != ""))) & ~F.col("_value").isin(*EMPTY))
    start = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(_WHITE)))
    return kept.select("doc_id", "location", start.alias("start"), (start + F.length("_value")).alias("end"), F.col("top.code").alias("entity_code"), F.col("_value").alias("text"), F.lit(SCORE).alias("score"))


def with_columns_rule(found: DataFrame, cells: DataFrame, codes: Iterable[str]) -> DataFrame:
    """found after the rule of columns: a ruled cell has its one finding, whatever was found in it before.

    A cell whose only finding is that very one keeps it, with its own score.
    """
    ruled = column_findings(cells, codes)
    keys = ["doc_id", "location"]
    alone = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("entity_code", "start", "end")).alias("_only"))
    joined = ruled.join(alone, keys, "left")
    same = (F.col("_n") == 1) & (F.col("_only.entity_code") == F.col("entity_code")) & (F.col("_only.start") == F.col("start")) & (F.col("_only.end") == F.col("end"))
    new = joined.filter(~F.coalesce(same, F.lit(False))).drop("_n", "_only")
    return found.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)
