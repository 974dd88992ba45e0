"""Categories, labels, scores, priorities, states and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, in catalogue order.
ENTITIES = {
    "NOMBRE": "Nombre de persona",
    "RUT": "RUT",
    "DIRECCION": "Dirección",
    "EMAIL": "Correo electrónico",
    "TELEFONO": "Teléfono",
    "FECHA_NACIMIENTO": "Fecha de nacimiento",
    "FECHA": "Fecha (cualquiera)",
    "PATENTE": "Patente vehicular",
    "IP": "Dirección IP",
    "CUENTA_BANCARIA": "Cuenta bancaria",
    "PASAPORTE": "Pasaporte",
    "TARJETA": "Tarjeta de crédito/débito",
    "WEB_REDES": "Sitio web / red social",
    "FOLIO": "N° de folio / expediente / ingreso",
    "FIRMA": "Firma manuscrita",
}
#: Which category wins an overlap.
PRIORITY = ["EMAIL", "WEB_REDES", "RUT", "IP", "TARJETA", "CUENTA_BANCARIA", "PASAPORTE", "FOLIO", "FECHA_NACIMIENTO", "TELEFONO", "PATENTE", "DIRECCION", "NOMBRE", "FECHA"]
#: Confidence by category; all others have DEFAULT_SCORE.
SCORES = {"NOMBRE": 0.7, "DIRECCION": 0.8, "FIRMA": 0.4}
DEFAULT_SCORE = 0.95
#: What an anonymised value shows; others show their code.
ANONYMOUS = {"DIRECCION": "DIRECCIÓN", "EMAIL": "CORREO", "TELEFONO": "TELÉFONO", "FECHA_NACIMIENTO": "FECHA NACIMIENTO", "CUENTA_BANCARIA": "CUENTA BANCARIA", "WEB_REDES": "WEB/RED"}
#: What an alias starts with.
ALIAS_PREFIX = {
    "NOMBRE": "Persona",
    "RUT": "RUT",
    "IP": "IP",
    "DIRECCION": "Dirección",
    "EMAIL": "Correo",
    "TELEFONO": "Teléfono",
    "FIRMA": "Firma",
    "FECHA_NACIMIENTO": "FechaNacimiento",
    "FECHA": "Fecha",
    "PATENTE": "Patente",
    "CUENTA_BANCARIA": "Cuenta",
    "PASAPORTE": "Pasaporte",
    "TARJETA": "Tarjeta",
    "WEB_REDES": "WebRed",
    "FOLIO": "Folio",
}
TREATMENTS = ("redact", "anonymize", "pseudonymize", "mask_full", "mask_partial")
LEVELS = ("fast", "balanced", "exhaustive")
PAGED_FORMATS = ("pdf", "jpg", "jpeg", "png", "tif", "tiff")
TEXT_FORMATS = ("docx", "xlsx", "txt", "doc", "xls")
#: A document's and a queue item's states.
DOCUMENT_STATES = ("uploaded", "processing", "review", "submitted", "approved", "protecting", "pending_approval", "protected", "protected_with_warnings", "verification_failed", "rejected", "failed")
ITEM_STATES = ("queued", "processing", "done", "verification_failed", "failed", "cancelled")
BLOCK = "█"


def entity_table(spark: SparkSession) -> DataFrame:
    """ord, code, label: 15 rows."""
    return spark.createDataFrame([(i, c, name) for i, (c, name) in enumerate(ENTITIES.items())], "ord int, code string, label string")
