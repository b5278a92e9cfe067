"""Patterns and word lists of problem 6; each finds candidates by their form. Names are judged by the corpus, see pii.py."""

from __future__ import annotations

import re

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_+-])?"
_AT = r"(?: ?\[(?i:at)\] ?| ?\((?i:at)\) ?| ?\{(?i:at)\} ?| AT )"
_DOT = r"(?: ?\[(?i:dot)\] ?| ?\((?i:dot)\) ?| ?\{(?i:dot)\} ?| (?i:dot) )"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+@-]){_LOCAL}(?:@(?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![A-Za-z0-9-]*[A-Za-z0-9@])"
    rf"|{_AT}(?:{_LABEL}(?:\.|{_DOT}))+[A-Za-z]{{2,}}(?![A-Za-z0-9@])"
    # in plain words only if the dots are words as well
    rf"| at (?:{_LABEL} dot )+[A-Za-z]{{2,}}(?![A-Za-z0-9@]))"
)

_EXT = r"(?:,? ?(?:ext(?:ension)?\.?|x|Durchwahl|DW|Nst\.?|anexo|extensión|#) ?\d{1,5}(?!\d))?"
_NOT_BEFORE = r"(?<![\w.+@#/:=-])(?<!\d[ -])"
PHONE = re.compile(
    rf"(?:{_NOT_BEFORE}(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .\-/]?(?:\(0\)[ .\-/]?)?(?:\(\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){5,12}"
    r"|(?:1[ .\-])?\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|(?:1([ .\-]))?\d{3}([-. ])\d{3}\2\d{4}"
    r"|\(0\d{1,4}\)[ \-/]?\d{3,8}(?:[ \-]\d{2,5}){0,2}"
    r"|0\d{1,4}[ /\-]\d{3,8}(?:[ \-]\d{2,5}){0,2}"
    rf")(?![\d]|[.\-/]\d){_EXT})"
)

ID_LABEL = (
    r"(?:SSN|social security (?:number|no\.?)|social sec\.? no\.?|ssn on file|national insurance (?:number|no\.?)|NI (?:no\.?|number)|NINO"
    r"|tax (?:identification number|identification no\.?|id(?: number)?|number|no\.?|file number)|TIN|TFN|Steuer-?(?:ID|Nr\.?|nummer)|Steueridentifikationsnummer|IdNr\.?"
    r"|passport (?:no\.?|number|nr\.?)|passport|Reisepass(?:nummer|-?Nr\.?)?|pasaporte(?: n[.ºo°]*\.?)?|Pass-?Nr\.?"
    r"|driver'?s? licen[cs]e(?: (?:no\.?|number))?|driving licen[cs]e(?: (?:no\.?|number))?|licen[cs]e (?:no\.?|number)|Führerschein(?:nummer| ?-?Nr\.?)?|(?:permiso|carnet|licencia) de conducir(?: n[.ºo°]*)?"
    r"|identity card(?: (?:no\.?|number))?|ID card(?: (?:no\.?|number))?|Personalausweis(?:nummer| ?-?Nr\.?)?|Ausweis(?:nummer|-?Nr\.?)?|DNI|NIE|NIF|documento de identidad|Sozialversicherungsnummer|SV-?Nr\.?|número de la seguridad social)"
)
_ID_FORMS = (
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2} \d{3} \d{3} \d{3}|\d{9,11}"
    r"|[A-Z]\d{3}-\d{4}-\d{4}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z0-9]*\d[A-Z0-9]{5,}"
)
ID_LABELLED = re.compile(rf"(?i:(?<![\w-]){ID_LABEL})(?i:[:#]? (?:is |ist |es |lautet |says )?|[:=#]\s?)({_ID_FORMS})(?![\w]|-\d)")
#: Forms that no other number has.
ID_BARE = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-Z]\d{3}-\d{4}-\d{4}|\d{8}-[A-Z])(?![\w-])")

_HOUSE = r"\d{1,4}(?: ?[a-zA-Z](?![\w]))?"
_UNIT = r"(?:,? (?:(?i:apt|apartment|unit|suite|ste|flat|floor|fl|whg|wohnung|piso|puerta|appt?)\.? ?(?:\d+ ?[A-Za-z]?|[A-Z])|#\d+[A-Za-z]?|\d{1,2}º ?[A-Za-z]?)(?![\w]))?"
_FULL = "street road avenue lane drive boulevard court place terrace way square close crescent row hill"
_SHORT = "st rd ave ln dr blvd ct pl ter sq cres"


def _kinds(style) -> str:
    full, short = (("|".join(style(w) for w in x.split())) for x in (_FULL, _SHORT))
    return rf"(?:(?:{full})(?![\w])|(?:{short})(?:\.|(?![\w])))"


_W = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]*"
_TITLE, _LOWER, _UPPER = r"[A-ZÀ-Þ][A-Za-zÀ-ÿ'-]*", r"[a-zß-ÿ][a-zß-ÿ'-]*", r"[A-ZÀ-Þ][A-ZÀ-Þ'-]*"
ADDRESS = re.compile(
    rf"(?<![\w.,:-])(?:"
    rf"{_HOUSE},? (?:{_TITLE} ){{1,3}}?{_kinds(str.capitalize)}{_UNIT}"
    rf"|{_HOUSE},? (?:{_UPPER} ){{1,3}}?{_kinds(str.upper)}{_UNIT}"
    rf"|{_HOUSE},? (?:{_LOWER} )(?:street|road|avenue|lane|drive|boulevard|(?:st|rd|ave|ln|dr|blvd)(?:\.|(?![\w])))(?![\w]){_UNIT}"
    rf"|{_HOUSE},? (?i:rue|avenue|chemin|boulevard|place|impasse|quai|allée|route) (?:(?i:de la|des|du|de) |(?i:de l'|d'))?{_W}(?![\w]){_UNIT}"
    rf"|(?i:C/|C\.|calle|avenida|avda\.?|av\.|plaza|pza\.|paseo|camino|carrer|ronda|travesía) ?(?:(?i:de la|de los|de las|del|de) )?{_W}(?: {_W})?,? (?:n[ºo°]\.? ?)?{_HOUSE}(?![\w]){_UNIT}"
    rf"|{_W}(?i:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig)(?![a-zA-Z]) {_HOUSE}(?![\w]){_UNIT}"
    rf"|(?:{_TITLE} )(?:Straße|Strasse|Weg|Allee|Platz|Gasse) {_HOUSE}(?![\w]){_UNIT}"
    r")"
)


def emails(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in EMAIL.finditer(text)] if "@" in text or "at" in text or "AT" in text else []


def phones(text: str, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    out = []
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 20 and not any(a < m.end() and m.start() < b for a, b in taken):
            out.append(m.span())
    return out


def id_numbers(text: str) -> list[tuple[int, int]]:
    out = [m.span(1) for m in ID_LABELLED.finditer(text)]
    return out + [m.span() for m in ID_BARE.finditer(text) if not any(a < m.end() and m.start() < b for a, b in out)]


def addresses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ADDRESS.finditer(text)]
