"""Personal information inside free text: typed spans, and the text with placeholders in their place.

Regular expressions propose spans. Validators (Luhn, mod-97, control letters, reserved number ranges, digit
counts) confirm or reject them. Words around a span raise or lower its score; spans of at least
``THRESHOLD`` are kept, of overlapping ones the higher, then the longer, then the earlier.

Names need no list: what a public tokenizer's vocabulary holds in small letters is an ordinary word, what it
holds in capitals only a proper noun, and a surname is mostly neither; the words around decide the rest.

Types: EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME, and CARD and IBAN for the redaction only.

Defined cases: null and empty texts have no span and stay as they are. Text that holds none of the signs a
rule needs is passed over by one regular expression. Repeated texts are scanned once per batch. An existing
column with the name of an output is replaced; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.tokens import RANKS, encoding
from sievework.sources.ship import ship_file

THRESHOLD = 0.5


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# --------------------------------------------------------------------------------------------- validators
def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) >= 12 and total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 of an IBAN."""
    s = re.sub(r"\s", "", iban).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def insee(digits: str) -> bool:
    """Key of a French social security number: 97 less the rest of the first 13 digits by 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def control_letter(number: str, letter: str) -> bool:
    """Control letter of a Spanish identity number, by the rest by 23."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == letter.upper()  # fixed values


def ssn_range(area: str, group: str, serial: str) -> bool:
    """Ranges that a United States social security number may have."""
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


# ------------------------------------------------------------------------------------------------- lexica
TITLE = r"(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Frau|Sr|Sra|Srta|Dr|Prof|Don|Doña)\b\.?"
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿ"
_SUR = rf"[{_UP}][{_LOW}]+(?:[-’'][{_UP}]?[{_LOW}]+)*"
NAME = re.compile(
    rf"(?<![\w@./-])(?:(?P<title>{TITLE})[ \u00a0]+(?:(?:[{_UP}]\.|{_SUR})[ \u00a0]+){{0,2}}(?P<tl>{_SUR})"
    rf"|(?P<rev>{_SUR}),[ \u00a0](?P<revgiven>[{_UP}][{_LOW}]+)(?:[ \u00a0][{_UP}]\.)?"
    rf"|(?P<given>[{_UP}][{_LOW}]+)(?:[ \u00a0][{_UP}]\.)?[ \u00a0](?P<sur>{_SUR})"
    rf"|(?P<ini>[{_UP}])\.[ \u00a0](?P<inisur>{_SUR})"
    rf"|(?P<caps>[{_UP}]{{2,}})(?:[ \u00a0][{_UP}]\.)?[ \u00a0](?P<capsur>[{_UP}]{{3,}}(?:-[{_UP}]+)?))(?![\w@]|\.\w|-\w)"
)
#: a word that leads a sentence, and the name that goes on behind the word after it
LEADING = re.compile(r"(?:As|Then|But|So|If|Since|Because|After|Before|Gestern|Heute|Dann|Aber|Hier|Puis|Mais|Ayer|Hoy|Luego|Pero|Please|Ask|Call|Tell|Yesterday|Today|Patient|Patientin|Customer|Tenant)\b")
NEXT = re.compile(rf"[ \u00a0](?:[{_UP}]\.[ \u00a0])?{_SUR}")
# Words before a name. After the first kind hardly anything else can stand.
NAME_STATED = re.compile(
    r"(?i)(?:\bname['\"]?\s*[:=]\s*['\"]?|\bmy name is|\bi am called|\bich heiße|\bmein name ist|\bme llamo|\bmi nombre es|\bje m'appelle|\bmon nom est|\bauthor|\bwritten by|\bsigned(?: by)?|\bunterzeichnet(?: von)?|\bfirmado(?: por)?|\bsigné(?: par)?)(?:[ \t\u00a0,]|:\s*)*\Z"
)
NAME_BEFORE = re.compile(
    r"(?i)\b(?:customer|client|kund(?:e|in)|cliente|patient(?:e|in)?|paciente|tenant|mieter(?:in)?|inquilin[oa]|locataire|employee|mitarbeiter(?:in)?|emplead[oa]|colleague|kolleg(?:e|in)|collègue|contact|kontakt|contacto|applicant|i am|je suis|soy|ich bin|this is|hier ist|c'est"
    r"|(?:parcel|package|letter|paket|brief|colis|lettre|paquete|carta) (?:for|to|für|an|pour|para)|reply to|attn\.?|attention|dear|liebe[r]?|lieber|cher|chère|estimad[oa]|hola|bonjour|hallo|hello|hi|(?:told|written|sent|done) by|ask(?:ed)?|fragen sie|demandez à|pregunte a|call(?:ed)?|met|met with|thanks to|minutes say that)(?:[ \t\u00a0,]|:\s*)*\Z"
)
NAME_NEAR = re.compile(r"(?i)(?:\b(?:yesterday|today|gestern(?: hat)?|heute(?: hat)?|hier|aujourd'hui|ayer|hoy|and|und|et|y|can|from|von|de|as|by|with|mit|avec|con)|\|)(?:[ \t\u00a0,]|:\s*)*\Z")
#: what a person does after the name
NAME_VERB = re.compile(r"^,?\s(?:told|said|says|wrote|writes|can|will|would|has|had|is|was|lives|works|joins?|asked|called|[a-z]{2,}ed|hat|ist|war|wohnt|sagt|a|est|était|habite|dit|ha|es|vive|dice|[a-zà-ÿ]{3,}(?:ó|te|it))\s")
SIGN_OFF = re.compile(r"(?i)^\s*(?:kind regards|best regards|regards|best wishes|sincerely|yours(?: \w+)?|cheers|thanks|mit freundlichen grüßen|viele grüße|liebe grüße|cordialement|bien à vous|amicalement|un saludo|saludos|atentamente|un cordial saludo)\s*[,.!]?\s*$")
ORGANISATION = re.compile(
    r"(?i)\b(?:ltd|inc|llc|gmbh|ag|corp|plc|s\.?a|sarl|bakery|& (?:sons|co)|sons|library|lake|project|dashboard|pipeline|street|road|lane|terrace|court|avenue|ave|blvd|kettle|ridge|park|school|university|club|office|library|hall|river|mount|hill|bridge|station|airport|hotel|cafe|café|museum|team|group|bank|press|news|server|manual|detection|box|apt|unit|not found)\b"
)
STOP_NAME = set("the a an our your my this that these those many in at as on for with from when why what who how there was were it is es il elle on un une le la les der die das ein eine wir ihr sie im am zum se en el los las por para cuando al una unos dear kind best regards hello hi yes no please note thanks customer tenant monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december new old great east west north south low high lake project street lane user password server database encrypt".split())

EMAIL = re.compile(
    r"(?<![\w.+@/:-])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]*)[\u200b\u200c\u2060]?(?P<at>\s?@\s?|\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s(?:AT|at)\s)[\u200b\u200c\u2060]?"
    r"(?P<dom>[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s(?:DOT|dot)\s)[A-Za-z0-9-]+)*)(?P<colon>[:/](?=\w))?"
)
# Forms of telephone numbers.
PHONE = re.compile(
    r"(?<![\w./+-])(?:"
    r"(?:\+|00)\s?\d{1,3}[\s. -]?(?:\(\d{1,4}\)[\s. -]?)?\d{1,4}(?:[\s. -]?\d{2,8}){1,4}"
    r"|\(\d{3,5}\)\s?\d{3,4}[-. ‑–]\d{3,4}"
    r"|1?[2-9]\d{2}[-. \u00a0\u2009\u202f\u2011\u2013]\d{3}[-. \u00a0\u2009\u202f\u2011\u2013]\d{4}"
    r"|1[2-9]\d{9}"
    r"|0\d{2,4}[\s/-]\d{3,5}[\s-]\d{3,4}"
    r"|0\d(?:[\s.-]\d{2}){4}"
    r")(?:\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5})?(?![\w-]|\.\d)"
)
NOT_PHONE = re.compile(r"(?i)(?:order|invoice|batch|ticket|tracking|timestamp|build|version|isbn|range|lot|part(?: number)?|serial|sku|rechnung|bestellung|facture|commande|factura|pedido|id|ref(?:erence)?|ip|port|epoch|page|article|item|model|card)[\s:#.nº°-]*$")
PHONE_WORD = re.compile(r"(?i)(?:phone|tel(?:efon|éfono|éphone)?|call|ring|mobile|cell|fax|numéro|número|nummer|rückruf|erreichbar|llámame|appelez)")
SSN = re.compile(r"(?<![\w.+-])(\d{3})([- ]?)(\d{2})\2(\d{4})(?![\w-]|\.\d)")
NIR = re.compile(r"(?<![\w.+-])[1-478]\s?\d{2}\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}(?![\w-]|\.\d)")
DNI = re.compile(r"(?<![\w.-])(?:(\d{8})-?([A-Z])|(\d{1,2}\.\d{3}\.\d{3})-?([A-Z])|[XYZ]-?\d{7}-?[A-Z])(?![\w-]|\.\d)")
PASSPORT = re.compile(r"(?<![\w.-])(?:[A-Z]\d{8}|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8})(?![\w-]|\.\d)")
STEUER = re.compile(r"(?<![\w.+-])[1-9]\d \d{3} \d{3} \d{3}(?![\w-]|\.\d)")
ID_WORD = re.compile(r"(?i)(?:passport|passeport|reisepass|pasaporte|travel document|personalausweis|ausweis|identi|national id|\bdni\b|\bnie\b|\bnif\b|social|soc\.? sec|soziale?|sécurité|seguridad|\bssn\b|steuer|tax id|form still shows|\bnumber\b|n°|nr\.)")
NOT_ID = re.compile(r"(?i)(?:lot|range|batch|order|invoice|part(?: number)?|serial|build|version|ticket|tracking|sku|isbn|model|commit|revision|flight|timestamp|phone|tel\.?|epoch)[\s:#.nº°-]*$")
UNIT_AFTER = re.compile(r"(?i)^\s*(?:ms|kg|mm|cm|km|bytes|kb|mb|of\s+\w+|rows|items|pcs)\b")
# Words for streets and postal boxes.
_STREET_EN = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Terrace|Court|Ct|Boulevard|Blvd|Drive|Dr|Way|Place|Square|Crescent|Close|Row|Parkway|Hwy)"
_UNIT = r"(?:,?[ ]?(?:#\s?\d+\w?|(?:Apt|Unit|Suite|Ste|Flat|Floor|No)\.?[ ]\w+))?"
_TOWN = rf"[{_UP}][\w'’-]*[{_LOW}](?:[ -][{_UP}][\w'’-]+){{0,3}}"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:"
    rf"\d{{1,5}}[a-z]?\s(?:[NSEW]\.?\s)?(?:[{_UP}][\w'’-]+\s){{1,3}}{_STREET_EN}\b\.?{_UNIT}(?:,\s*{_TOWN}(?:,?\s*(?:[A-Z]{{2}}\s*)?\d{{4,6}}(?:-\d{{4}})?)?)?"
    rf"|(?i:p\.?\s?o\.?\s?box|postfach|apartado(?: de correos)?|boîte postale|\bBP(?=\s))\s*\d{{1,6}}(?:,\s*{_TOWN}(?:\s\d{{4,6}})?)?"
    rf"|(?:[{_UP}][{_LOW}]+(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm|steig|hof|markt)|(?:[{_UP}][\w-]+\s)(?:Straße|Weg|Allee|Platz|Gasse|Ring))\s\d{{1,4}}\s?[a-z]?\b(?:,\s*\d{{4,5}}\s{_TOWN})?"
    rf"|(?:Am|An der|Auf dem|Im|In der|Zum|Zur)\s[{_UP}][\w-]+(?:\s[{_UP}][\w-]+)?\s\d{{1,4}}\s?[a-z]?,\s*\d{{4,5}}\s{_TOWN}"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|chemin|impasse|boulevard|bd|allée|place|quai|route|cours|passage|square|sentier)\s(?:(?:de la|de l'|du|des|de|d')\s?)?[{_UP}][\w'’-]+(?:[ -][{_UP}][\w'’-]+)*(?:,\s*\d{{5}}\s{_TOWN})?"
    rf"|(?:C/|Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carretera|Ronda|Travesía)\s?(?:(?:de las|de los|de la|del|de)\s)?[{_UP}][\w'’-]+(?:\s(?:de\s)?[{_UP}][\w'’-]+)*,?\s\d{{1,4}}(?:,\s*(?:bajo|\d+º\s?\w*\.?))?(?:,\s*\d{{5}}\s{_TOWN})?"
    rf")"
)
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?\b")
# Words before the names of French streets.
_RUE = r"(?:rue|avenue|av\.|chemin|impasse|boulevard|bd|allée|place|quai|route|cours|passage|square|sentier)"
GATE = re.compile(rf"@|\b[aA][tT]\b|\d{{2}}|[{_UP}]\d|[{_UP}]{{9}}|[{_UP}][\w.’'-]*,?\s+[{_UP}]|[\w.’'-],?\s\d|(?i:box|postfach|apartado|correos|postale|bp\s)\s*\d|\d\s?(?:bis|ter|quater)?,?\s{_RUE}\s")
#: what any number rule, any address and any written-out e-mail address needs
NUMBERS = re.compile(r"\d(?:[\s().\-/\u2011\u2013]{0,2}\d){6}|[A-Z0-9]{8}")
HOUSE = re.compile(rf"\d{{1,5}}\s?(?:bis|ter|quater|[a-z])?,?\s(?:bis|ter|quater)?,?\s?(?:[{_UP}]|{_RUE}\s)|[\w.’'-],?\s\d{{1,4}}\s?[a-z]?\b|(?i:box|postfach|apartado|correos|postale|\bbp\s)")
WRITTEN = re.compile(r"[\[({]\s?at|\b(?:at|AT)\s+[A-Za-z0-9-]+(?:\.[A-Za-z]|\s(?:dot|DOT)\s|\s?[\[({]\s?dot)")
TLD = re.compile(r"(?i)^(?:[a-z]{2}|com|net|org|edu|gov|mil|int|info|biz|name|pro|app|dev|online|shop|site|tech|cloud|example|test|invalid|local|mail|email|museum|coop|jobs|mobi|travel)$")


class Casing:
    """What a public tokenizer's vocabulary knows of the case of a word.

    The vocabulary holds frequent spellings whole. A word that is whole in capitals only is a proper noun; one
    that is whole in small letters is an ordinary word; one that is never whole is unknown, as most surnames
    are and as many given names. So no list of names is needed.
    """

    def __init__(self, path: str = RANKS):
        e = encoding(path)
        self.size = lambda w: len(e.encode_ordinary(" " + w))
        self.kind = lru_cache(100_000)(self._kind)

    def _kind(self, word: str) -> str:
        small, large = self.size(word.lower()), self.size(word[:1].upper() + word[1:].lower())
        return "ordinary" if small == 1 else "proper" if large == 1 else "unknown"


class Finder:
    """Finds personal data in a text. ``alone``: the text was cut out of another by some validator."""

    #: how likely a word of each kind is a given name or a surname
    GIVEN = {"proper": 0.2, "unknown": 0.1, "ordinary": 0.05}
    SURNAME = {"proper": 0.1, "unknown": 0.2, "ordinary": -0.1}

    def __init__(self, path: str = RANKS):
        self.casing = Casing(path)

    def _emails(self, t: str) -> Iterator[Span]:
        at = 0
        while m := EMAIL.search(t, at):
            at = m.end("local")  # a word before the address may have looked like its local part
            dom = re.sub(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s(?:DOT|dot)\s", ".", m["dom"])
            labels = dom.split(".")
            plain = m["at"].strip() == "@"
            if len(labels) < 2 or not TLD.match(labels[-1]) or m["colon"] or re.fullmatch(r"[\d.]+", dom) or re.search(r"\dx\.(?:png|jpe?g|gif|svg|webp)$", m[0]):
                continue
            if m["local"].lower() == "git" or not plain and m["at"].strip().lower() == "at" and ("." in m["dom"] and not re.search(r"[._+\d]", m["local"])):
                continue
            before = t[max(0, m.start() - 24) : m.start()]
            if re.search(r"\w://[^\s]*$|\b(?:ssh|scp|sftp|rsync|telnet|mosh|clone)\s+(?:-\S+\s+)*$", before):
                continue  # login part of a link or a remote
            at = m.end()
            yield Span(m.start(), m.end(), "EMAIL", 0.95 if plain else 0.8)

    def _numbers(self, t: str) -> Iterator[Span]:
        for m in PHONE.finditer(t):
            digits = sum(c.isdigit() for c in re.sub(r"(?i)\s?(?:ext|x|durchwahl|poste).*", "", m[0]))
            before, score = t[max(0, m.start() - 28) : m.start()], 0.6
            if not 9 <= digits <= 15 or NOT_PHONE.search(before) or UNIT_AFTER.match(t[m.end() :]) or re.search(r"://[^\s]*$", before):
                continue
            if PHONE_WORD.search(before):
                score += 0.3
            if m[0][:1] in "+(" or m[0].startswith("00"):
                score += 0.1
            yield Span(m.start(), m.end(), "PHONE", score)
        for m in SSN.finditer(t):
            before, score = t[max(0, m.start() - 40) : m.start()], 0.35
            if not ssn_range(m[1], m[3], m[4]) or NOT_ID.search(before) or UNIT_AFTER.match(t[m.end() :]):
                continue
            score += 0.25 * bool(m[2]) + 0.4 * bool(ID_WORD.search(before)) + 0.3 * (m[0] == t.strip(" .,;)"))
            yield Span(m.start(), m.end(), "ID_NUMBER", score)
        for m in NIR.finditer(t):
            before = t[max(0, m.start() - 40) : m.start()]
            score = 0.4 + 0.5 * insee(re.sub(r"\D", "", m[0])) + 0.3 * bool(ID_WORD.search(before)) + 0.2 * (" " in m[0])
            yield Span(m.start(), m.end(), "ID_NUMBER", score)
        for m in DNI.finditer(t):
            number, letter = m[1] or (m[3] or "").replace(".", ""), m[2] or m[4]
            before = t[max(0, m.start() - 40) : m.start()]
            ok = not number or control_letter(number, letter)
            if NOT_ID.search(before):
                continue
            yield Span(m.start(), m.end(), "ID_NUMBER", 0.35 + 0.3 * ok + 0.3 * bool(ID_WORD.search(before)) + 0.2 * (m[0] == t.strip(" .,;)")) + 0.1 * bool(m[3]))
        for m in PASSPORT.finditer(t):
            before = t[max(0, m.start() - 40) : m.start()]
            if NOT_ID.search(before):
                continue
            alone = m[0] == t.strip(" .,;)") and any(c.isdigit() for c in m[0])
            yield Span(m.start(), m.end(), "ID_NUMBER", 0.2 + 0.5 * bool(ID_WORD.search(before)) + 0.35 * alone)
        for m in STEUER.finditer(t):
            yield Span(m.start(), m.end(), "ID_NUMBER", 0.2 + 0.5 * bool(ID_WORD.search(t[max(0, m.start() - 40) : m.start()])))
        for m in CARD.finditer(t):
            if luhn(re.sub(r"\D", "", m[0])) and not NOT_PHONE.search(t[max(0, m.start() - 28) : m.start()]):
                yield Span(m.start(), m.end(), "CARD", 0.7)
        for m in IBAN.finditer(t):
            if mod97(m[0]):
                yield Span(m.start(), m.end(), "IBAN", 0.99)

    def _addresses(self, t: str) -> Iterator[Span]:
        for m in ADDRESS.finditer(t):
            before = t[max(0, m.start() - 24) : m.start()]
            if re.search(r"(?i)(?:page|slot|route|lamp|version|chapter|figure|table|order|build|step)\s*$", before):
                continue
            yield Span(m.start(), m.end(), "ADDRESS", 0.8)

    def _names(self, t: str, alone: bool) -> Iterator[Span]:
        at, kind = 0, self.casing.kind
        while m := NAME.search(t, at):
            at = m.end()
            given = m["given"] or m["revgiven"] or m["caps"]
            sur = m["sur"] or m["rev"] or m["inisur"] or m["capsur"] or m["tl"]
            start = m.start()
            before, after = t[max(0, start - 40) : start], t[m.end() : m.end() + 20]
            if m["title"] is None and (given or "").lower() in STOP_NAME:
                at = m.start() + len(given)  # the next word may begin a name
                continue
            if m["title"] is None and m["sur"] and LEADING.match(t, m.start()) and (more := NEXT.match(t, m.end())):
                at = m.end() - len(sur)  # "As Dario Lamdray": the second word begins the name
                continue
            score = 0.65 if m["title"] else 0.25 if m["ini"] else 0.05
            if m["title"] is None:
                score += (self.GIVEN[kind(given)] if given else 0) + self.SURNAME[kind(sur.rsplit("-", 1)[-1])]
            if m["caps"] and sum(map(str.isalpha, before[-15:])) > 1 and before[-15:].isupper():
                score -= 0.3  # the text around it is in capitals too
            stated = bool(NAME_STATED.search(before))
            if stated or NAME_BEFORE.search(before):
                score += 0.55 if stated else 0.45
            elif NAME_NEAR.search(before):
                score += 0.2
            score += 0.1 * bool(given and NAME_VERB.match(after))
            # a name that is the whole text, or its own line below a greeting
            if (start == 0 or t[start - 1] == "\n") and re.match(r"\s*[.,;)]?\s*(?:\n|\Z)", t[m.end() :]):
                head = t[:start].rstrip("\n").rsplit("\n", 1)[-1]
                score += 0.45 if SIGN_OFF.match(head) else 0.3 if alone else 0
            if ORGANISATION.search(m[0]) or re.match(r"(?i)\s*(?:&|ltd\b|inc\b|gmbh\b|library|dashboard|pipeline|street|road|lane|ave\b|court|rd\b|blvd|terrace|\w+ (?:ltd|gmbh)\b)", after) or re.search(r"(?i)(?:project|lake|mount|the|\d)\s$", before):
                score -= 0.6
            if sur.lower() in STOP_NAME:
                score -= 0.5
            if score < THRESHOLD:
                at = m.start() + len(re.split(r"[ \u00a0,]", m[0], maxsplit=1)[0])  # the next word may begin a name
            yield Span(start, m.end(), "NAME", score)

    def spans(self, text: str, alone: bool = False) -> list[Span]:
        """Spans of ``text`` in order, none overlapping another."""
        if not text or not GATE.search(text):
            return []
        found = [*self._names(text, alone)]
        if "@" in text or WRITTEN.search(text):
            found += self._emails(text)
        if NUMBERS.search(text):
            found += self._numbers(text)
        if HOUSE.search(text):
            found += self._addresses(text)
        kept: list[Span] = []
        for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (-s.score, s.start - s.end, s.start)):
            if all(s.end <= k.start or s.start >= k.end for k in kept):
                kept.append(s)
        return sorted(kept)

    def redact(self, text: str, alone: bool = False) -> str:
        parts, last = [], 0
        for s in self.spans(text, alone):
            parts += [text[last : s.start], f"[{s.kind}]"]
            last = s.end
        return "".join(parts) + text[last:]


@lru_cache
def finder(path: str = RANKS) -> Finder:
    """One finder per process and vocabulary."""
    return Finder(path)


SPAN = "array<struct<start:int,length:int,line_no:int,kind:string,score:double>>"
FOUND_KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")


def found(alone: bool = False, path: str = RANKS):
    """A Column function: personal data of a text column as an array of spans (code points from 0)."""
    ship_file(path)

    @F.pandas_udf(SPAN)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            rows = [[{"start": x.start, "length": x.end - x.start, "line_no": v.count("\n", 0, x.start) + 1, "kind": x.kind, "score": x.score} for x in finder(path).spans(v, alone)] for v in values]
            yield pd.Series([rows[c] if c >= 0 else [] for c in codes], index=s.index)

    return apply


def redacted(alone: bool = False, path: str = RANKS):
    """A Column function: the text with typed placeholders; null stays null."""
    ship_file(path)

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            done = [finder(path).redact(v, alone) for v in values]
            yield pd.Series([done[c] if c >= 0 else None for c in codes], index=s.index, dtype=object)

    return apply


def personal_lines(df: DataFrame, id_col: str, column: str, alone: bool = False) -> DataFrame:
    """(rec_id, line_no, pii_type), distinct: lines on which a piece of personal data begins, once per type.

    With ``alone`` the line is always 1.
    """
    spans = df.select(F.col(id_col).alias("rec_id"), found(alone)(F.col(column)).alias("spans"))
    wanted = F.filter("spans", lambda x: x["kind"].isin(*FOUND_KINDS))
    # a text holds its lines once, so the distinct needs no shuffle; the outer form keeps the optimiser from
    # testing for empty arrays first, which would run the finder twice
    keys = F.array_distinct(F.transform(wanted, lambda x: F.struct((F.lit(1) if alone else x["line_no"]).alias("line_no"), x["kind"].alias("pii_type"))))
    return spans.select("rec_id", F.inline_outer(keys)).where("line_no is not null")
