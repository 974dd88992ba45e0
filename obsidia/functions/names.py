"""Names of persons in plain text: vocabulary and context."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession

from .normalize import plain_strip
from .patterns import CAPITALISED, COURT_PARTY, NAME_AFTER_TITLE, NAME_SEQUENCE

#: Some common first names and surnames, without accents: defaults of a parameter. For recall pass longer lists; see read_vocabulary().
FIRST_NAMES = frozenset(
    "adriana alberto alejandra alejandro alfredo ana andrea andres angela antonia antonio barbara beatriz camila carla carlos carmen carolina catalina cecilia claudia claudio cristian cristina "
    "daniel daniela david diego eduardo elena elisa ester fabian felipe fernanda fernando francisca francisco gabriel gabriela gloria gonzalo guillermo gustavo hector hernan hugo ignacio isabel "
    "ivan jaime javier javiera jorge jose josefa juan juana julia julio karen laura leonardo lorena luis luisa manuel marcela marcelo marco margarita maria mario marta martin mauricio miguel "
    "monica natalia nicolas olga oscar pablo pamela paola patricia patricio paula pedro rafael ramon raul ricardo roberto rocio rodrigo rosa ruben samuel sandra sebastian sergio silvia sofia "
    "susana tomas valentina valeria veronica vicente victor victoria ximena yolanda rene mabel paulina".split()
)
SURNAMES = frozenset(
    "acuna aguilar alarcon alvarado alvarez angulo aravena araya arriagada barrera bravo bustos caceres campos cardenas carrasco castillo castro contreras cortes diaz duran espinoza fernandez "
    "figueroa flores fuentes garcia garrido gomez gonzalez guerrero gutierrez henriquez hernandez herrera ibanez jara jimenez lagos lara lopez maldonado martinez medina mendoza miranda molina "
    "morales moreno munoz navarro nunez olivares orellana ortega ortiz parra pena perez pino pizarro poblete ponce ramirez ramos reyes rios rivera rodriguez rojas romero ruiz saez salazar "
    "salinas sanchez sandoval sepulveda silva soto tapia toledo toro torres uribe valdes valencia valenzuela vargas vasquez vega venegas vera vergara vidal villalobos zuniga".split()
)
#: Words that end a name because an institution or the sentence goes on.
INSTITUTION = frozenset(
    "subsecretaria subsecretario ministerio ministro ministra division departamento gobierno chile santiago region republica ley decreto resolucion exento exenta oficio ordinario "
    "telecomunicaciones direccion oficina servicio superintendencia empresa sociedad limitada spa ltda transparencia unidad seccion gabinete fiscalia contraloria general nacional publica publico "
    "municipalidad ilustre honorable senado camara diputados tribunal corte suprema apelaciones consejo comision estado fiscal jefe jefa secretaria secretaria alcalde salud director directora "
    "desam proveedor comercial comercializadora asegurado asegurada asegurando abogado abogada integrante fecha programa".split()
)
PROSE = frozenset(
    "destaca consulta confirma informa pregunta responde explica indica senala menciona solicita manifiesta expresa sostiene agrega precisa aclara comenta reitera plantea presenta propone advierte "
    "comunica felicita agradece interviene coincide gestiona tambien ademas quien quienes que se sobre ante para por con sin este esta estos estas existe una un".split()
)
#: Words that start no person's name.
NO_PERSON = frozenset("colegio universidad constructora inmobiliaria consultora fundacion asociacion comite familia que el la los las de del y".split())
_NEVER_FIRST = frozenset("integrante fecha ministro secretario".split())
_LOOSE = frozenset("de del la las los y".split())
_STOPS = INSTITUTION | PROSE

_TOKEN = re.compile("[A-Za-zÁÉÍÓÚÑÜáéíóúñü]+")
#: Where a name ends, over one letter a token (see NameFinder.classes): before a second person's «y» and first name, before a stop, and before a connector that leads to one.
_END = re.compile(r"(?<=..)y(?=[fX])|(?<=.)[ly](?=[xX])|(?<=.)[xX]")


class _Evidence(NamedTuple):
    """A pattern whose group 1 begins with a name, the words that are needed, and what else must hold of them."""

    pattern: re.Pattern
    least: int
    holds: Callable[[NameFinder, list[str]], bool]
    #: Is the group the name as it is?
    whole: bool = False
    #: What a text of a match has: found far faster than the pattern.
    guard: Callable[[str], bool] = bool


class NameFinder:
    """Finds names with a vocabulary of first names and surnames (lower case, no accents)."""

    def __init__(self, first_names: frozenset[str] = FIRST_NAMES, surnames: frozenset[str] = SURNAMES):
        self.first_names, self.surnames = first_names, surnames

    def classes(self, words: list[str]) -> str:
        """A letter for each word: x stop, X stop and first name, y «y», l connector, f first name, w another."""

        def letter(w: str) -> str:
            if w in _STOPS:
                return "X" if w in self.first_names else "x"
            return "y" if w == "y" else "l" if w in _LOOSE else "f" if w in self.first_names else "w"

        return "".join(map(letter, words))

    def leading_name(self, run: str) -> tuple[list[str], int]:
        """The words of the name that a run of capitalised words begins with, and where it ends; no words if it can't be one."""
        tokens = list(_TOKEN.finditer(run))
        words = [plain_strip(t[0]) for t in tokens]
        if not words or words[0] in _NEVER_FIRST:
            return [], 0
        end = _END.search(self.classes(words))
        words = words[: end.start()] if end else words
        return words, tokens[len(words) - 1].end()

    def is_person(self, words: list[str]) -> bool:
        """Does a name begin with a first name, or end with two surnames?"""
        return words[0] in self.first_names or (3 <= len(words) <= 5 and words[0] not in INSTITUTION | NO_PERSON and self.surnames.issuperset(words[-2:]))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Offsets of names; they may overlap and repeat."""
        for e in _EVIDENCE:
            if not e.guard(text):
                continue
            for m in e.pattern.finditer(text):
                words, end = ([plain_strip(m[1])], len(m[1])) if e.whole else self.leading_name(m[1])
                if len(words) >= e.least and e.holds(self, words):
                    yield m.start(1), m.start(1) + end


_CAPITAL_AFTER = re.compile(r"[rRaAnNoOgG]\.?[^\S\r\n]+(?=[A-ZÁÉÍÓÚÑÜ])")
_TITLE = re.compile(r"(?i)\b(?:Sr|Sra|Srta|Dn|Dña|Don|Doña|Señor|Señora|Abogado|Abogada|Ing|Dr|Dra)$")


def _may_follow_title(text: str) -> bool:
    """Is there a capital after a title, or a colon?"""
    return ":" in text or any(_TITLE.search(text[max(0, m.start() - 9) : m.start() + 1]) for m in _CAPITAL_AFTER.finditer(text))


def _may_be_case(text: str) -> bool:
    return "caratul" in text.lower()


_EVIDENCE = (
    _Evidence(re.compile(NAME_AFTER_TITLE), 1, lambda finder, words: " ".join(words) not in _STOPS, guard=_may_follow_title),
    _Evidence(re.compile(COURT_PARTY), 1, lambda finder, words: words[0] not in INSTITUTION | NO_PERSON, whole=True, guard=_may_be_case),
    _Evidence(re.compile(NAME_SEQUENCE), 2, NameFinder.is_person),
)


def read_vocabulary(spark: SparkSession, path: str) -> frozenset[str]:
    """A list of names from a text file in any of Spark's stores, one a line; in lower case, without accents. For a driver: lists, not corpora."""
    return frozenset(plain_strip(r.value).strip() for r in spark.read.text(path).filter("trim(value) <> ''").collect())
