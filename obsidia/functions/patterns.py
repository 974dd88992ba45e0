"""What the text of each category looks like.

Python syntax; java() adds the flags that give the same classes in Spark.
"""

from __future__ import annotations

from typing import NamedTuple

_H = r"[^\S\r\n]"
_GAP = _H + r"{0,2}(?:\n" + _H + r"{0,2})?"
_AT = r"(?:@|[\(\[]" + _GAP + r"(?:arroba|at)" + _GAP + r"[\)\]]|arroba|[\(\[]" + _GAP + r"[A-Za-z0-9]" + _GAP + r"[\)\]]?)"
#: What follows the local part of an address whose signs may be spelled or parted.
OBSCURED_HOST = _AT + _GAP + r"[A-Za-z0-9_-]{1,63}(?:" + _GAP + r"\." + _GAP + r"[A-Za-z0-9_-]{1,63}){0,4}" + _GAP + r"\." + _GAP + r"[A-Za-z]{2,24}(?![\w-])"
_MONTH = "(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
_DATE = r"(?:(?<!\d)\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}(?!\d)|(?<!\d)\d{1,2}\s+de\s+" + _MONTH + r"\s+(?:de\s+)?\d{4}(?!\d))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NUMBER_SIGN = r"(?:n\s*[^A-Za-z0-9\s]{0,3}\s*)?[:.]?\s*"


class Detector(NamedTuple):
    code: str
    pattern: str
    #: 0, or 1 for a group that ends the match.
    group: int = 0
    ignore_case: bool = False
    #: A cheap pattern that every match implies.
    guard: str | None = None
    #: Name of the check in validators.
    check: str | None = None
    #: Only where no earlier match of the category lies.
    fallback: bool = False


#: In order of emission.
DETECTORS = [
    Detector("EMAIL", r"[\w.%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}", guard="@"),
    Detector(
        "EMAIL",
        r"(?<![\w.%+-])[\w%+-]{1,64}(?:" + _GAP + r"\." + _GAP + r"[\w%+-]{1,64}){0,8}" + _GAP + OBSCURED_HOST,
        ignore_case=True, guard=r"[@(\[]|(?i)arroba", fallback=True,
    ),
    Detector("WEB_REDES", r"(?:https?://|www\.)\S+(?:(?<=[/\-_=?&])\n[^\s@]+)?|(?<![\w@.])@[A-Za-z0-9_.]{3,30}\b", ignore_case=True, guard=r"@|://|(?i)www\."),
    Detector("RUT", r"(?<![\d.])\d{1,2}(?:" + _H + r"*\.?" + _H + r"*\d{3}){2}" + _H + r"*-?\s*[\dkK](?![\d])", guard=r"\d{3}\s*-?\s*[\dkK]", check="rut"),
    Detector("IP", r"(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\d)", guard=r"\d\.\d"),
    Detector("TARJETA", r"(?<![\d])(?:\d{4}[\s-]?){3}\d{4}(?![\d])", guard=r"\d{4}[\s-]?\d{4}[\s-]?\d{4}", check="luhn"),
    Detector("CUENTA_BANCARIA", r"(?:cuenta\s+(?:corriente|vista|rut|de\s+ahorro|bancaria)?|cta\.?\s*(?:cte\.?)?|n[°º]\s*de\s*cuenta)\s*" + _NUMBER_SIGN + r"(\d[\d\s.-]{5,22}\d)", 1, True, r"(?i)cuenta|cta"),
    Detector("PASAPORTE", r"pasaporte\s*" + _NUMBER_SIGN + r"([A-Z0-9]{6,12})", 1, True, "(?i)pasaporte"),
    Detector("FOLIO", r"(?:folio|expediente|exp\.|ingreso|(?:causa\s+)?rol|n[°º]\s*de\s*(?:ingreso|solicitud|caso|ticket))\s*(?:n[°º]\.?)?\s*[:.]?\s*([A-Z]{0,3}[-\s]?\d[\d.\-/]{2,20})", 1, True, r"(?i)folio|expediente|exp\.|ingreso|rol|n[°º]\s*de"),
    Detector("FECHA_NACIMIENTO", r"(?:fecha\s+de\s+nacimiento|nacid[oa]\s+(?:el|en)|nacimiento|f\.\s*nac\.?)\s*[:.]?\s*(" + _DATE + ")", 1, True, r"(?i)nac"),
    Detector("TELEFONO", r"(?<![\d.])(?:\+?56[\s.-]?)?(?:\(?\s?(?:9|2|3[2-9]|4[1-5]|5[1-8]|6[1-7]|7[1-5])\s?\)?[\s.-]?)\d{3,4}[\s.-]?\d{4}(?![\d])", guard=r"\d{3}[\s.-]?\d{4}", check="phone"),
    Detector("TELEFONO", r"\b(?:tel[eé]fono|tel\s+fono|fono|celular)" + _H + r"*[:.]?" + _H + r"*(0[2-9][\s.-]?\d{7,8})(?!\d)", 1, True, r"(?i)fono|celular"),
    Detector("PATENTE", r"(?<![A-Z0-9])(?:[B-DF-HJ-LP-TV-Z]{4}[.\-\s]?\d{2}|[A-Z]{2}[.\-\s]?\d{4})(?![A-Z0-9])", guard=r"[A-Z]{2}[.\-\s]?\d\d", check="plate"),
    Detector(
        "DIRECCION",
        r"\b(?:Av\.|Avda\.|Avenida|Calle|Pasaje|Pje\.|Camino|Ruta|Callej[oó]n|Diagonal|Alameda|Parcela|Lote|Km\.?)" + _H
        + r"+[A-ZÁÉÍÓÚÑ0-9][^\n,;]{1,60}?" + _H + r"*(?:N[°º]" + _H + r"*)?\d{1,5}"
        + r"(?:" + _H + r"*(?:," + _H + r"*)?(?:depto\.?|departamento|oficina|of\.?|piso|casa|local|block)" + _H + r"*\w{1,6})*"
        + r"(?:" + _H + r"*," + _H + r"*(?:comuna" + _H + r"+de" + _H + r"+)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:" + _H + r"+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)?)?",
        ignore_case=True, guard=r"(?i)(?:\bav|calle|pasaje|pje|camino|ruta|callej|diagonal|alameda|parcela|lote|\bkm)[^\n]*\d",
    ),
    Detector("FECHA", _DATE, ignore_case=True, guard=r"\d[/.-]\d|(?i)\d\s+de\s", check="date"),
]

#: A capitalised word, and words that may stand between two of a name.
CAPITALISED = "(?:[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]{1,40}|[A-ZÁÉÍÓÚÑÜ]{2,40})"
CONNECTOR = "(?:de|del|la|las|los|y|San|Santa|Da|Di|Van|Von|De|Del|La)"
_NEXT = f"(?:{_H}+(?:{CONNECTOR}{_H}+)?{CAPITALISED})"
#: Every start of two to five capitalised words.
NAME_SEQUENCE = rf"(?=(\b{CAPITALISED}{_NEXT}{{1,4}}\b))"
#: One to five capitalised words after a title, or after a field's name and colon.
NAME_AFTER_TITLE = (
    rf"(?:(?i:\b(?:Sr|Sra|Srta|Dn|Dña|Don|Doña|Señor|Señora|Abogado|Abogada|Ing|Dr|Dra))\.?{_H}+|"
    rf"(?i:(?:nombre(?:{_H}+completo)?|representante(?:{_H}+legal)?|solicitante|denunciante|reclamante|funcionari[oa]|interesad[oa]|contratista|trabajador[a]?|firmante|apoderad[oa])){_H}*:{_H}*)"
    rf"({CAPITALISED}{_NEXT}{{0,4}})"
)
#: The party of a case.
COURT_PARTY = rf"(?i:\bcaratulad[oa]){_H}*[:.]?{_H}*[\"“~]?({CAPITALISED})(?=\s+(?i:con)\b)"
#: What readers of scans make of an at sign.
MISREAD_AT = r"(?<=[\w.+-])(?:[\(\[]\s?[A-Za-z0-9]\s?[\)\]]?|[©®ⓐ])(?=[\w.-]+\.\w{2,})"
#: Characters that end no value.
TRAILING = ".,;:)"


def java(detector: Detector) -> str:
    return ("(?iU)" if detector.ignore_case else "(?U)") + detector.pattern
