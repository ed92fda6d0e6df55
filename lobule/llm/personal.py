"""Personal information in free text: high-recall generators, boosted trees, calibrated thresholds, typed placeholders.

Generators propose overlapping spans of five kinds. Every span is described by its format and by the words around it, and scored by
gradient-boosted trees, one model a kind, which are trained here on generated sentences (`training`); scores are calibrated on held-out
sentences, on which the threshold of each kind is set as well. Of overlapping spans above their thresholds the likeliest stays.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vocabulary files of public tokenizers, read where the models are trained; their words are a lexicon.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
KINDS = ["email", "phone", "id_number", "address", "name"]
TRAINING_SENTENCES = 2000  # generated texts that the models are fitted on, of five sentences each; a third is held out for calibration

# Written forms, as plain lists.
STREETS = "Street|St|Road|Rd|Lane|Ln|Drive|Court|Ct|Avenue|Ave|Close|Way|Place|Square|Terrace|Boulevard|Blvd|Crescent|Gardens|Row|Walk|Hill|Park|Parkway|Pkwy|Circle|Highway"
GERMAN_STREETS = "straße|strasse|str\\.|gasse|weg|platz|allee|ufer|ring|damm|markt|steig|hof|chaussee"
FRENCH_STREETS = "rue|avenue|boulevard|place|impasse|chemin|allée|quai|cours|square|passage|route"
SPANISH_STREETS = "Calle|C/|Avda\\.?|Avenida|Plaza|Paseo|Camino|Carrer|Ronda|Travesía"
PARTICLES = "von|van|de|der|den|del|della|di|da|du|des|la|le|zu|zur|zum|bin|ibn|ten|ter|dos|das|af|av"
TITLES = set("dr prof professor mr mrs ms miss herr frau mme mlle monsieur madame sr sra srta señor señora don doña sir".split())
# Roles, correspondence and prepositions that often stand before a person, in the four languages.
PERSON_CUES = set("contact kontakt contacto contacter regards sincerely greetings saludos grüße cordialement operator visitor colleague author reviewer supervisor nurse student technician manager director doctor patient teacher engineer chair secretary assistant by for to with from an à a de von par por mit dear hello hi attn attention cc signed call ask hola liebe lieber cher chère name called operador visitante besucher visiteur kollege kollegin collègue colega".split())
COLOURS = set("red blue green yellow orange violet black white brown purple grey gray pink teal".split())
# Words that begin sentences or name things, so are no part of a person's name, in the four languages: function words, then words of the
# calendar, of correspondence and titles, and of the trade.
COMMON = set(
    """the a an in on at of to for from by with and or but as is are was were be been it its this that these those we our you your they their he she his her i my me us no not all any both each every after
    add before if how what when where which who why while once only since then there here also about into over under between through during against two three four one first second next last
    der die das den dem des ein eine im am um und oder bei für nach vor über unter mit ohne nicht wir sie ist sind
    le la les un une du au aux et ou sur pour avec sans après avant dans nous vous est sont
    el los las una del al en por para con sin tras antes son está
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    dear hello regards sincerely thanks please kindly yours best note contact kontakt contacto call write reply ask question questions answer report form file letter invoice order copy mail page figure table section panel part room number street road lane drive court avenue close flat apt rue calle
    bitte danke frau herr anfrage rechnung merci bonjour écrire joindre dossier facture gracias hola escribir llamar ficha factura
    dr prof professor mr mrs ms miss mme mlle sr sra señor señora passport ssn nino dni nir ausweis-nr reisepass steuer-id personalnummer operator visitor reviewer author
    cell cells tissue section stain lane slide sample median control group state status step run export section model linear test""".split()
)
# Given names that are common where the four languages are spoken.
GIVEN = set(
    """james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony margaret mark sandra paul ashley
    steven emily andrew kimberly george anna kevin laura brian amanda edward rebecca peter helen jason rachel ryan emma jacob grace simon alice oliver sophie samuel julia henry olivia jack ruth hannah joan amy
    hans anja klaus petra wolfgang sabine jürgen ursula stefan monika andreas claudia lukas lena felix greta jonas ingrid matthias heike karl eva max jan lars
    jean marie pierre nathalie michel isabelle philippe sylvie alain catherine nicolas camille julien louise antoine chloé luc claire hugo zoë rené léa marc inès
    josé maría juan carmen antonio ana manuel isabel francisco lucía javier elena carlos marta miguel sofía pablo irene diego inés luis rosa jorge pilar
    ivan olga dmitri katarzyna marco giulia mohammed fatima omar leila arjun priya wei hiro yuki amina victor maria sofia robert tess""".split()
)
NOUN_END = re.compile(r"(?:ing|ed|tion|sion|ment|ness|ity|ous|able|ible|ally|ical|ics|ology|graphy|ase|ose|ism|ung|heit|keit|schaft|ción|dad|mente|ique|age|ture|ance|ence|oma|some|plex|type|test|line|view|cell|cells|blot|stain|system)s?$")
NAME_END = re.compile(r"(?:son|sen|ez|ov|ova|ev|eva|ski|sky|ska|mann|man|ini|etti|elli|eau|oux|berg|stein|vic|ić|yan|ian|dze|enko|idis|oglu|ström|er|ton|ley|ham|field|ford|worth)$")
PERSONAL_NUMBER = r"(?:personal|identity|identification|citizen|resident|taxpayer|patient|insurance|member|student|employee|staff|personnel|payroll|pension|social insurance|health card|medicare|voter|driver'?s? licen[cs]e|military) (?:ID|no\.?|number|code|card)(?: no\.?| number)?|personnummer|codice fiscale|BSN|PESEL|TFN|CURP|Sozialversicherungsnummer|Versichertennummer|Passnummer|numéro de passeport|carte d'identité|número de pasaporte|número de la seguridad social|SSN|social security(?: number| no\.?)?|NINO|NI number|NI no\.?|national insurance(?: number| no\.?)?|NIR|INSEE|DNI|NIE|NIF|CPR|passport(?: number| no\.?| nr\.?)?|Reisepass(?:-Nr\.?|nummer)?|passeport(?: n°| no\.?)?|pasaporte(?: n\.?º| no\.?)?|staff (?:ID|no\.?|number)|employee (?:ID|no\.?|number)|personnel (?:ID|no\.?|number)|Personalnummer|Personal-Nr\.?|matricule|national ID(?: number| no\.?)?|ID card(?: no\.?| number)?|identity (?:card|number|no\.?)(?: no\.?| number)?|Ausweis-Nr\.?|Ausweisnummer|Personalausweis(?:-Nr\.?)?|health insurance(?: no\.?| number)?|insurance (?:no\.?|number)|NHS (?:no\.?|number)|Steuer-ID|tax (?:ID|no\.?|number)|driving licen[cs]e(?: no\.?| number)?|licen[cs]e no\.?|Krankenversicherung(?:s-Nr\.?|snummer)?|n° de sécurité sociale|numéro de sécurité sociale"
DEVICE_NUMBER = r"lot|batch|run|key|SN|Cat\.|AUP|counter|read|serial|version|v|order|invoice|no|tray|room|slide|case|table|stack|ticks|position|tile|cell|cells|gain|pixel|item|row|mouse|cage|charge|flacon|frasco|accession|ref|protocol|grant|isbn|doi|part|model|build|rows"

_L = "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
_U, _S = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿā-ž"
# Each generator starts from a cheap anchor, so that the long patterns are tried at few places.
_ATS = [re.compile(r"@"), re.compile(r"[(\[{]\s*(?:at|AT|At)\s*[)\]}]"), re.compile(r"at(?<=\sat)(?=\s)"), re.compile(r"AT(?<=\sAT)(?=\s)")]
_DIGITS = re.compile(r"[0-9+(](?<![\w@/\-.].)[\d\s().\-/]{5,}\d")
_LETTERED = re.compile(r"[A-Z](?<![\w@/\-.].)[A-Z]{0,2}[ \-]?\d[A-Z\d]{0,8}[ .\d]")
_SHORT_POSTCODE = re.compile(r",\s[0-9]{4}(?<=[0-9A-Za-z],\s.{4})(?=\s{1,3}[A-Z])")
_POSTCODE = re.compile(r"[0-9]{5}(?<![\w.,/\-].{5})(?![\w/])|[A-Z](?<!\w.)[A-Z]?\d[A-Z\d]?\s{1,3}\d[A-Z]{2}(?!\w)")
_CUE_END = re.compile(r"(?:SSN|ssn|number|code|fiscale|licen[cs]e|BSN|PESEL|TFN|CURP|personnummer|pasaporte|identité|social|no\.|Nr\.|nummer|ID|NINO|nino|NIR|DNI|NIE|NIF|CPR|INSEE|passport|Reisepass|passeport|pasaporte|matricule|Ausweis|sociale|card|[nN]\.?[º°])(?!\w)(?:\s{0,3}[:#]|\s{1,3}is)?\s{1,3}(?=[A-Z0-9 .\-]{0,6}\d)")
_CUE_WORDS = ["SSN", "ssn", "number", "code", "fiscale", "licence", "license", "BSN", "PESEL", "TFN", "CURP", "identité", "social", " no.", "Nr.", "nummer", " ID", "NINO", "nino", "NIR", "DNI", "NIE", "NIF", "CPR", "INSEE", "passport", "Reisepass", "passeport", "pasaporte", "matricule", "Ausweis", "sociale", "card", "nº", "n.º", "Nº", "N.º", "n°", "n.°", "N°", "N.°"]
_VALUE = re.compile(r"[A-Z0-9][A-Z0-9.\-/]*(?:\s{1,3}(?=[A-Z]?\d|[A-D]\b)[A-Z0-9]{1,5}\b)*")
_CAPS = re.compile(rf"[{'A-ZÀ-ÖØ-Þ'}](?<![\w@.\-].)[{'A-Za-zÀ-ÖØ-öø-ÿĀ-ž'}.'’\-]*,?\s{{1,3}}(?:[a-zA-Z]{{2,5}}\s{{1,3}}){{0,2}}[{'A-ZÀ-ÖØ-Þ'}]")
_LOCAL = re.compile(rf"[{_L}0-9][{_L}0-9._%+'\-]*\s{{0,2}}$")
_DOT = r"(?:\.|\s{0,2}[(\[{]\s*(?:dot|DOT|\.)\s*[)\]}]\s{0,2}|\s+(?:dot|DOT)\s+)"
_DOMAIN = re.compile(rf"\s{{0,2}}((?:[{_L}0-9\-]+{_DOT})+[{_L}]{{2,}})(?![{_L}0-9])")
_W = r"\s{1,3}"
_EXT = rf"(?:,?\s{{0,3}}(?:ext\.?|extension|x|Durchwahl|poste|extensión)\s{{0,2}}\d{{1,5}})?"
PHONE = re.compile(
    rf"""(?<![\w@.+/\-])(?:
    (?:\+|00)\d{{1,3}}(?:[\s.\-]{{0,2}}\(0\))?(?:(?:[.\-/]|\s{{1,3}}(?:[\-/]\s{{1,3}})?)?\(?\d{{1,5}}\)?){{2,7}}
    |\(\d{{3}}\)\s{{0,3}}\d{{3}}[\s.\-]{{1,2}}\d{{4}}
    |(?:1[\s.\-])?\d{{3}}[\s.\-]\d{{3}}[\s.\-]\d{{4}}
    |\d{{3}}-\d{{4}}
    |0\d(?:[\s.\-]{{1,2}}\d{{2}}){{4}}
    |0\d{{2,5}}/\d{{4,9}}(?:-\d{{1,5}})?
    |\(?0\d{{2,5}}\)?{_W}\d{{3,4}}(?:{_W}\d{{3,4}})?
    |\(?0\d{{2,4}}\)?{_W}\d{{5,8}}
    |[6-9]\d\d(?:{_W}\d{{3}}){{2}}
    |[6-9]\d\d(?:{_W}\d\d){{3}}
    |\d{{10,11}}
    ){_EXT}(?![\w@]|[.,\-/]\d)""",
    re.X,
)
NUMBER = re.compile(
    rf"""(?<![\w@+/\-.])(?:
    \d{{3}}[\s\-]?\d{{2}}[\s\-]?\d{{4}}
    |[A-Z]{{2}}\s?\d{{2}}\s{{0,3}}\d{{2}}\s{{0,3}}\d{{2}}\s{{0,3}}[A-D]
    |[A-Z]{{1,3}}-?\d{{5,9}}[A-Z]?
    |[A-Z]\d{{3}}[.\s]{{1,3}}\d{{3}}(?:[.\s]{{1,3}}\d{{3}})?
    |\d{{8}}-?[A-Z]
    |[XYZ]-?\d{{7}}-?[A-Z]
    |[0-4](?:\s{{0,3}}\d{{2}}){{3}}(?:\s{{0,3}}\d{{3}}){{2}}(?:\s{{0,3}}\d{{2}})?
    |\d{{6}}-\d{{4}}
    |[A-Z]\d[A-Z0-9]{{7,8}}
    |\d{{2}}(?:\s{{1,3}}\d{{3}}){{3}}
    |\d{{3}}\s{{1,3}}\d{{3}}\s{{1,3}}\d{{4}}
    )(?![\w@]|[\-/]\d)""",
    re.X,
)
_TOWN = rf"(?:(?:New|Bad|San|Santa|Saint|St\.?|Los|Las|Le|La|El|Port|Fort|Lake|North|South|East|West|Sankt){_W})?[{_U}][{_L}'’\-]+"
_NAMES = rf"(?:[{_U}][{_L}'’.\-]*{_W}){{1,3}}"
_POST = rf"(?:[A-Z]{{1,2}}\d[A-Z\d]?{_W}\d[A-Z]{{2}}|\d{{5}}(?:-\d{{4}})?)"
_FLAT = rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor|Wohnung|Appt\.?)\s{{1,3}}\w{{1,5}}"
ADDRESS = re.compile(
    rf"""(?<![\w@])(?:
    (?:{_FLAT},?{_W})?\d{{1,5}}[a-zA-Z]?,?{_W}{_NAMES}(?:{STREETS})\b\.?,?{_W}(?:{_FLAT},?{_W})?{_TOWN},?{_W}(?:[A-Z]{{2}}{_W})?{_POST}
    |(?:{_NAMES})?[{_U}][{_L}\-]*(?:{GERMAN_STREETS}){_W}\d{{1,4}}\s?[a-z]?,?{_W}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{_W}{_TOWN}
    |\d{{1,4}}(?:{_W}(?:bis|ter|quater))?,?{_W}(?:{FRENCH_STREETS}){_W}(?:(?:de{_W}la|de{_W}l['’]|du|des|de|d['’]){_W}?)?(?:[{_U}][{_L}'’\-]*,?{_W}){{1,3}}(?:F-)?\d{{5}}{_W}{_TOWN}
    |(?:{SPANISH_STREETS}){_W}(?:(?:de|del|la|los|las){_W}){{0,2}}(?:[{_U}][{_L}'’\-]*{_W}){{1,3}}\d{{1,4}},?{_W}(?:\d{{1,2}}\s?\.?[ºª°]?\s{{0,2}}[A-Z]?,?{_W})?\d{{5}}{_W}{_TOWN}
    )(?![\w@])""",
    re.X,
)
_ROAD = rf"(?:(?:{PARTICLES}|of|the|am|an|auf|im|in|unter|y|e|et|sur|sous|lès|les){_W})?[{_U}\d][{_L}\d'’.\-]*,?"
OPEN_ADDRESS = re.compile(
    rf"""(?<![\w@.,\-])(?:
    (?:{_FLAT},?{_W})?\d{{1,5}}[a-zA-Z]?(?:[\-/]\d{{1,4}})?,?{_W}(?:{_ROAD}{_W}){{1,7}}(?:[A-Z]{{2}},?{_W})?{_POST}
    |(?:{_ROAD}{_W}){{1,5}}\d{{1,4}}\s?[a-zA-Z]?(?:[\-/]\d{{1,4}})?,{_W}(?:[A-Z]{{1,2}}-)?\d{{4,5}}(?:{_W}[A-Z]{{2}})?{_W}(?:[A-Z]{{2}}{_W})?{_TOWN}(?:{_W}[{_U}][{_L}]+)?
    |\d{{1,4}}(?:{_W}(?:bis|ter|quater))?,?{_W}(?:{FRENCH_STREETS}){_W}(?:(?:de|du|des|la|le|l['’]|d['’])\s{{0,3}}){{0,3}}(?:[{_U}][{_L}'’\-]*,?{_W}){{1,4}}(?:F-)?\d{{5}}{_W}{_TOWN}
    )(?![\w@])""",
    re.X,
)
_CAP = rf"[{_U}](?:[{_S}'’]+|[{_S}'’]*-[{_U}][{_S}'’]+)(?:[{_U}][{_S}]+)?(?:-[{_U}][{_S}]+)*"
_ALL = rf"[{_U}]{{2,}}(?:-[{_U}]{{2,}})*"
_PART = rf"(?:(?:{PARTICLES}){_W}){{1,2}}"
_BIGPART = rf"(?:(?:{PARTICLES.upper()}|{PARTICLES}){_W}){{1,2}}"
NAME = re.compile(
    rf"""(?<![\w@.\-])(?=[{_U}])(?:
    (?:{_PART})?{_CAP},{_W}(?:{_CAP})(?:{_W}[{_U}]\.(?!\w))?
    |(?:{_ALL}),{_W}(?:{_ALL})(?:{_W}[{_U}]\.(?!\w))?
    |(?:{_CAP}|[{_U}]\.)(?:{_W}[{_U}]\.){{0,2}}(?:{_W}{_CAP}){{0,1}}{_W}(?:{_PART})?{_CAP}(?:{_W}{_CAP})?
    |(?:{_ALL}|[{_U}]\.)(?:{_W}[{_U}]\.){{0,2}}{_W}(?:{_BIGPART})?{_ALL}(?:{_W}{_ALL})?
    )(?![\w@])""",
    re.X,
)
_SMALL = re.compile(rf"(?<![\w@.\-])(?:[{_S}'’]{{2,}}|[{_S}]\.)(?:{_W}[{_S}]\.)?(?:{_W}(?:{PARTICLES})){{0,2}}{_W}[{_S}'’]{{3,}}(?:-[{_S}]+)?(?!\w)|(?<![\w@.\-])[{_S}'’]{{3,}}(?:-[{_S}]+)?,{_W}[{_S}'’]{{2,}}(?!\w)")
ROLES = PERSON_CUES - set("by for to with from an à a de von par por mit cc ask call name called signed".split())
_ROLE = re.compile(rf"(?<!\w)(?:Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|Frau|Herr|Sra?|{'|'.join(sorted(w.capitalize() for w in ROLES))}|{'|'.join(sorted(ROLES))})(?!\w)[.,:]?\s{{1,3}}")
_ROLE_FORMS = {w + end for r in (ROLES | TITLES) for w in (r, r.capitalize()) for end in ("", ".", ",", ":", ".:")}
_BREAK = re.compile(r"[.!?;]\s")
_START = re.compile(rf"(?:(?<=[.!?:|])|^)[ \t\n]{{0,3}}(?=[{_S}])", re.M)
_TOKEN = re.compile(rf"[{_L}]+(?:[.'’\-][{_L}]+)*\.?|\d[\d.,:/\-]*|\S")
_PERSON_NUMBER_BEFORE = re.compile(rf"(?<!\w)(?:{PERSONAL_NUMBER})[\s:#.]{{0,4}}(?:is\s{{1,3}})?$", re.I)
_DEVICE_BEFORE = re.compile(rf"(?<!\w)(?:{DEVICE_NUMBER})[\s:#.]{{1,4}}$", re.I)
_PHONE_BEFORE = re.compile(r"(?:mobile|phone|tel|telephone|call|fax|cell|mobil|telefon|téléphone|tél|teléfono|móvil|au|al|unter|at|on|ring|dial|ext)[\s:.|]{1,4}$", re.I)
_ID_TAIL = re.compile(r"(?:ticks|rows|cells|slides|bottle|bases|counts|bp|px|µ|nm|mM|%|°)", re.I)


def spans(text: str) -> list[tuple[int, int, int]]:
    """All proposed (kind number, from, to); kinds and spans overlap freely."""
    found: list[tuple[int, int, int]] = []
    for pattern in _ATS:
        for m in pattern.finditer(text):
            a, b = m.span()
            right = _DOMAIN.match(text, b, b + 120)
            if not right:
                continue
            left = _LOCAL.search(text, max(0, a - 70), a)
            if not left:
                continue
            end = right.end()
            while text[end - 1] in ".-":
                end -= 1
            after = text[end : end + 12].lstrip().lower()
            if after[:1] == "@" or after[:4] in ("(at)", "[at]", "{at}") or text[end : end + 1] in ("+", "_"):
                continue
            found.append((0, left.start(), end))
    for m in _DIGITS.finditer(text):
        a, b = m.start(), m.end() + 20
        for x in PHONE.finditer(text, a, b):
            if x.end() < b or b >= len(text):
                if 7 <= sum(c.isdigit() for c in x.group()) <= 18:
                    found.append((1, x.start(), x.end() - (x.group()[-1] == ")" and "(" not in x.group())))
        found += [(2, x.start(), x.end()) for x in NUMBER.finditer(text, a, b) if x.end() < b or b >= len(text)]
    for m in _LETTERED.finditer(text):
        x = NUMBER.match(text, m.start())
        if x:
            found.append((2, x.start(), x.end()))
    for m in filter(None, (_CUE_END.match(text, at) for at in places(text, _CUE_WORDS))):
        if not _PERSON_NUMBER_BEFORE.search(text, max(0, m.start() - 40), m.end()):
            continue
        x = _VALUE.match(text, m.end())
        if x:
            a, b = x.span()
            while b > a and text[b - 1] in ".-/":
                b -= 1
            if sum(c.isdigit() for c in text[a:b]) >= 4:
                found.append((2, a, b))
    for m in (*_POSTCODE.finditer(text), *_SHORT_POSTCODE.finditer(text)):
        a, b = max(0, m.start() - 110), m.end() + 60
        for pattern in (ADDRESS, OPEN_ADDRESS):
            found += [(3, x.start(), x.end()) for x in pattern.finditer(text, a, b) if x.end() > m.start() and x.start() < m.start()]
    at = 0
    while m := _CAPS.search(text, at):
        first = text[m.start() : m.end()].split(None, 1)[0].rstrip(",")
        at = m.start() + len(first) if first.rstrip(".").lower() in COMMON and not (len(first) == 2 and first[1] == ".") else -1
        if at >= 0:
            continue  # a name may begin at the next word
        x = NAME.match(text, m.start())
        at = m.start() + len(first)
        if x:
            found += [(4, a, b) for a, b in name_spans(text, x.start(), x.end())]
    # names in small letters: after a role or preposition, at the beginning of a sentence, or before a piece of another kind
    spots = {m.end() for m in _START.finditer(text)}
    if not _ROLE_FORMS.isdisjoint(text.split()):
        spots |= {m.end() for m in _ROLE.finditer(text)}
    for at in spots:
        x = _SMALL.match(text, at)
        if x and not _plain(x.group()):
            found.append((4, x.start(), x.end()))
    for a in {a for k, a, _ in found if k < 4}:
        for w in _SMALL_WORD.finditer(text, max(0, a - 60), a):
            x = _SMALL.match(text, w.start(), a)
            if x and a - x.end() <= 28 and not _BREAK.search(text, x.end(), a) and not _plain(x.group()):
                found.append((4, x.start(), x.end()))
    return sorted(set(found))


def places(text: str, words: list[str]) -> list[int]:
    """Where any of the words begins, without the blank that a word may begin with."""
    found = set()
    for w in words:
        at = text.find(w)
        while at >= 0:
            found.add(at + (w[0] == " "))
            at = text.find(w, at + 1)
    return sorted(found)


def _plain(part: str) -> bool:
    """Whether a word of it is a common one, so that it is no name in small letters."""
    return any(w in COMMON or w in PERSON_CUES and w not in _PARTICLE_SET or NOUN_END.search(w) for w in part.replace(",", " ").split())


def checked(part: str) -> bool:
    """Whether a number carries a valid check digit or letter: Spanish and French numbers, sums modulo 11, or the Luhn rule."""
    bare = re.sub(r"[\s.\-]", "", part).upper()
    digits = re.sub(r"\D", "", bare)
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", bare):
        number = int(bare[:-1].translate(str.maketrans("XYZ", "012")))
        return "TRWAGMYFPDXBNJZSQVHLCKE"[number % 23] == bare[-1]
    if len(digits) == 15 and digits == bare:
        return 97 - int(digits[:13]) % 97 == int(digits[13:])
    if len(digits) == 10 and digits == bare:
        rest = 11 - sum(int(c) * (10 - i) for i, c in enumerate(digits[:9])) % 11
        if rest % 11 == int(digits[9]):
            return True
    if len(digits) >= 9 and digits == bare:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return False


def name_spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The match, without words at its ends that no name has, and its shorter parts of at least two words."""
    parts = [(m.start() + a, m.end() + a) for m in re.finditer(r"\S+", text[a:b])]
    bad = [text[x:y].strip(".,").lower() in COMMON and not (y - x == 2 and text[y - 1] == ".") for x, y in parts]
    out = []
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            inside = text[parts[i][0] : parts[j][1]]
            if any(bad[k] and text[parts[k][0] : parts[k][1]].lower() not in _PARTICLE_SET for k in range(i, j + 1)) or inside.endswith(","):
                continue
            last = text[parts[j][0] : parts[j][1]]
            if last.lower() in _PARTICLE_SET or (len(last) == 2 and last[1] == "." and "," not in inside):
                continue
            out.append((parts[i][0], parts[j][1]))
    return out


_PARTICLE_SET = set(PARTICLES.split("|"))


def near_words(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before, after = text[max(0, a - 40) : a], text[b : b + 40]
    if a > 40:
        before = before.partition(" ")[2]
    return [w.lower() for w in _TOKEN.findall(before)[-3:]], [w.lower() for w in _TOKEN.findall(after)[:3]]


@lru_cache(2)
def lexicon(vocabularies: tuple[str, ...] = VOCABULARIES) -> tuple[frozenset[str], frozenset[str]]:
    """Words that public tokenizers know whole, in small letters, and those they know with a capital only: ordinary words, and names."""
    small, capital = set(), set()
    for path in vocabularies:
        with open(path, "rb") as file:
            for line in file:
                token = base64.b64decode(line.split()[0]).decode(errors="ignore")
                if token[:1] == " " and len(token) > 3 and token[1:].isalpha():
                    (small if token.islower() else capital if token[1:].istitle() else set()).add(token[1:].lower())
    return frozenset(small), frozenset(capital - small)


def features(text: str, found: list[tuple[int, int, int]], known: tuple[frozenset[str], frozenset[str]]) -> np.ndarray:
    """One row for each span: format first, then context; known: lexicon()."""
    out = np.zeros((len(found), WIDTH))
    named = any(k == 4 for k, _, _ in found)
    lower = set(text.split()) if named else set()
    local = " ".join(text[a:b].lower() for k, a, b in found if k == 0) if named else ""
    contact = [(a, b) for k, a, b in found if k in (0, 1, 3) or k == 2 and _PERSON_NUMBER_BEFORE.search(text, max(0, a - 40), a)]
    for row, (kind, a, b) in zip(out, found):
        part = text[a:b]
        left, right = near_words(text, a, b)
        before, after = text[max(0, a - 40) : a], text[b : b + 12]
        row[0] = len(part)
        row[1] = digits = sum(c.isdigit() for c in part)
        row[2] = letters = sum(c.isalpha() for c in part)
        row[3] = part.count("-")
        row[4] = part.count(".")
        row[5] = len(part.split())
        row[6] = part[0] == "+" or part[:2] == "00"
        row[7] = "(" in part
        row[8] = part[0] == "0"
        row[9] = sum(c.isupper() for c in part) / max(1, letters)
        row[10] = bool(_PERSON_NUMBER_BEFORE.search(before))
        row[11] = bool(_DEVICE_BEFORE.search(before)) and not row[10]
        row[12] = bool(_PHONE_BEFORE.search(before))
        row[13] = bool(_ID_TAIL.match(after.lstrip()))
        row[14] = bool(left and left[-1] in "|") or bool(right and right[0] in "|")
        row[15] = bool(left and left[-1].strip(".:") in PERSON_CUES) or bool(len(left) > 1 and left[-1] in ":,.|(" and left[-2].strip(".") in PERSON_CUES)
        row[16] = bool(left and left[-1].strip(".") in TITLES) or bool(len(left) > 1 and left[-2] in TITLES and left[-1] == ".")
        opens = before.rstrip(" \t")[-1:] in ("", ".", "!", "?", ":", "|", "\n", ";")
        row[17] = opens and after[:1] == " " and after[1:2].islower()
        row[31] = opens
        row[38] = bool(left and left[-1] in PREPOSITIONS)
        row[18] = bool(right[:2] == ["et", "al."] or right[:1] == ["et"] or right[:2] == ["and", "colleagues"])
        around = before + text[b : b + 40]
        row[30] = sum(c.isupper() for c in around) / max(1, sum(c.isalpha() for c in around))
        row[19] = any(0 <= x - b <= 24 or 0 <= a - y <= 24 for x, y in contact if (x, y) != (a, b))
        if kind == 4:
            words = part.replace(",", " ").split()
            small = [w.strip(".").lower() for w in words]
            row[20] = any(w in COLOURS for w in small)
            row[21] = sum(w in COMMON for w in small if w not in _PARTICLE_SET)
            row[22] = "," in part
            row[23] = any(len(w) == 2 and w[1] == "." for w in words)
            row[24] = any(w in _PARTICLE_SET for w in small)
            row[25] = part.islower() + 2 * part.isupper()
            row[26] = min(len(w) for w in small)
            # a longer proposal that holds this one, or one that overlaps it
            row[32] = small[0] in GIVEN or "," in part and small[-1] in GIVEN
            row[33] = sum(bool(NOUN_END.search(w)) for w in small)
            row[34] = any(w in local for w in small if len(w) > 3)
            row[35] = sum(w in lower for w in small if len(w) > 2 and not part.islower())
            row[39] = sum(w in known[0] for w in small if w not in _PARTICLE_SET)
            row[40] = sum(w in known[1] for w in small)
            row[41] = len(words)
            row[36] = bool(NAME_END.search(small[-1]))
            row[37] = min((x - b for x, _ in contact if x >= b), default=99)
            row[27] = sum(k == 4 and x <= a and y >= b and (x, y) != (a, b) for k, x, y in found)
            row[28] = bool(left and left[-1][:1].isalpha() and before[-1:].isspace() and text[max(0, a - 2)] not in ".:!?,|(" and before.split()[-1][:1].isupper() if before.split() else False)
            row[29] = bool(right and after[:1] == " " and text[b + 1 : b + 2].isupper())
        elif kind in (1, 2):
            row[20] = any(k == 3 - kind and (x < b and y > a) for k, x, y in found)
            row[21] = text[a - 1 : a] in ("-", ".", "/", "_")
            groups = re.findall(r"\d+", part)
            row[22] = len(groups)
            row[23] = len(groups[0]) if groups else 0
            row[24] = len(groups[-1]) if groups else 0
            row[25] = part[-1].isalpha()
            row[26] = part[0].isalpha()
            row[27] = checked(part) if kind == 2 else "ext" in part
            row[28] = "\n" in part
            row[32] = any(k == 4 and 0 < a - y <= 3 for k, _, y in found)
        elif kind == 0:
            row[20] = part.count("@")
            row[21] = len(re.split(r"[.\s]", part)[-1])
            row[22] = bool(re.search(r"\s(?:at|AT)\s", part))
            row[23] = bool(re.search(r"\sdot\s|[\[(]dot", part))
        else:
            row[20] = part.count(",")
            row[21] = "\n" in part
            row[22] = bool(re.match(r"\d", part))
            row[23] = bool(_STREET_WORD.search(part))
            row[24] = sum(w[:1].isupper() for w in part.split())
            row[25] = sum(w[:1].islower() and w not in _PARTICLE_SET for w in part.split())
    return out


WIDTH = 42
PREPOSITIONS = set("by for to with from of and at via an à a de von par por mit bei für und et y con para pour avec than like as".split())
_STREET_WORD = re.compile(rf"(?<!\w)(?:{STREETS}|{FRENCH_STREETS}|{SPANISH_STREETS}|via|viale|piazza|corso)(?!\w)|(?:{GERMAN_STREETS}|straat|laan|gatan|gade|vej)(?!\w)", re.I)
_SMALL_WORD = re.compile(rf"(?<!\w)[{_S}]{{3,}}(?!\w)")


class Trees:
    """Gradient-boosted regression trees for logistic loss, over features binned at their quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 5.0, bins: int = 32):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for c in x.T]
        binned = self.bin(x)
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rate, self.depth = rate, depth
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree, at = self.grow(binned, y - p, np.maximum(p * (1 - p), 1e-6), least)
            self.trees.append(tree)
            score += rate * tree[2][at]

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)]).astype(np.int16)

    def grow(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple:
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int16), np.zeros(nodes)
        at = np.zeros(len(binned), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = gradient[rows], weight[rows]
            value[node] = g.sum() / (h.sum() + 1.0)
            if 2 * node + 2 >= nodes or len(rows) < 2 * least:
                continue
            best, whole = 1e-6, g.sum() ** 2 / (h.sum() + 1.0)
            for j in range(binned.shape[1]):
                b = binned[rows, j]
                width = len(self.cuts[j]) + 1
                if width < 2:
                    continue
                gs, hs, n = np.cumsum(np.bincount(b, g, width)), np.cumsum(np.bincount(b, h, width)), np.cumsum(np.bincount(b, minlength=width))
                gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - whole
                gain[(n < least) | (n[-1] - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, k
            if feature[node] >= 0:
                right = binned[rows, feature[node]] > cut[node]
                at[rows] = 2 * node + 1 + right
        return (feature, cut, value), at

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self.bin(x)
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                right = binned[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += self.rate * value[at]
        return out


def training(sentences: int = TRAINING_SENTENCES, seed: int = 1) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Generated sentences with the true spans in them, and many that hold none but look alike."""
    rng = random.Random(seed)
    pick = rng.choice
    letters, given = "bcdfghjklmnprstvwz", sorted(GIVEN)

    def made_up(low: int = 2, high: int = 3) -> str:
        return "".join(pick(letters) + pick("aeiouyöéå" if rng.random() < 0.1 else "aeiou") + pick(["", "", "n", "r", "l", "s", "ck"]) for _ in range(rng.randint(low, high))).capitalize()

    def number(form: str) -> str:
        return "".join(str(rng.randrange(10)) if c == "#" else pick("ABCDEFGHKLMNPRSTXZ") if c == "@" else c for c in form)

    def name() -> str:
        first, last = (pick(given).capitalize() if rng.random() < 0.5 else made_up(1, 3)), made_up(2, 3) + pick(["", "son", "er", "ini", "ez", "sen", "ov"])
        if rng.random() < 0.12:
            last += "-" + made_up()
        if rng.random() < 0.08:
            last = pick(PARTICLES.split("|")[:12]) + " " + last
        middle = pick(["", "", "", "", " " + pick("ABDEJKLMRST") + "."])
        form = rng.random()
        if form < 0.15:
            return f"{last}, {first}"
        if form < 0.3:
            return f"{first[0]}. {last}"
        whole = f"{first}{middle} {last}"
        return whole.upper() if form < 0.42 else whole.lower() if form < 0.5 else whole

    def email() -> str:
        local = pick([made_up().lower(), f"{made_up().lower()}.{made_up().lower()}", f"{made_up().lower()}_{made_up().lower()}{rng.randrange(99)}", f"{pick('abcde')}.{made_up().lower()}+{made_up(1, 2).lower()}"])
        at, dot = pick([("@", ".")] * 5 + [(" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot ")])
        return local + at + dot.join([made_up().lower(), *pick([[], [made_up().lower()]]), pick(["com", "org", "net", "example", "edu", "de"])])

    def phone() -> str:
        form = pick(["+44 (0)20 #### ####", "020 #### ####", "07### ######", "0#### ######", "+44 7### ### ###", "(###) ###-####", "###.###.####", "+1 ### ### ####", "+1-###-###-#### ext. ###", "###-####", "###-####", "###-####", "##########", "+33 1 ## ## ## ##", "0#.##.##.##.##", "01 ## ## ## ##", "030/########", "+49 30 ##### ###", "0049 (0)30 #####-###", "+46 8 ### ### ##", "6## ### ###"])
        return number(form)

    def identity() -> tuple[str, str]:
        return pick([("SSN", "###-##-####"), ("SSN:", "### ## ####"), ("SSN:", "000 ## ####"), ("SSN", "00#-##-####"), ("social security number", "#########"), ("NINO", "@@######B"), ("NI number", "@@ ## ## ## C"), ("passport no.", "@@#######"), ("passport", "X########"), ("staff ID", "@@-#####"), ("employee no.", "E###.###"), ("DNI", "########@"), ("NIR", "1 ## ## ## ### ### ##"), ("national ID", "######-####"), ("health insurance no.", "@### ### ###"), ("patient number", "########"), ("member ID", "@@######"), ("identity card no.", "@########"), ("driving licence no.", "@@@@######@"), ("tax ID", "## ### ### ###"), ("PESEL", "###########"), ("BSN", "#########"), ("insurance number", "##-######-@-###"), ("Personalnummer", "######"), ("Ausweis-Nr.", "L#@@#####")])

    def address() -> str:
        town, street = made_up() + pick(["ton", "ville", "berg", "ford", ""]), made_up()
        return pick([
            f"{rng.randrange(1, 300)} {street} {pick(['Street', 'Road', 'Lane', 'Drive', 'Ave.', 'Court', 'Close', 'Rd'])}{pick([', ', chr(10)])}{town} {number('#####')}",
            f"{rng.randrange(1, 300)} {street} Street, Apt {rng.randrange(30)}B, {town}, {pick(['MN', 'VT', 'OR'])} {number('#####')}",
            f"Flat {rng.randrange(1, 40)}, {rng.randrange(1, 200)} {street} Road, {town} {number('ZZ# #QQ')}", f"{street}{pick(['straße', 'weg', 'gasse', 'str.'])} {rng.randrange(1, 200)}{pick(['', 'a', 'b'])}, {number('#####')} {town}",
            f"{rng.randrange(1, 2000)} {street} {pick(['Avenue NW', 'Street', 'Road', 'Blvd', 'Way'])}, {town}, {pick(['DC', 'TX', 'CA', 'NY'])} {number('#####')}", f"{pick(['Unter den', 'Am', 'An der', 'Im', 'Via', 'Zum'])} {street} {rng.randrange(1, 200)}, {number('#####')} {town}", f"{street}straat {rng.randrange(1, 99)}, {number('####')} {number('@@')} {town}", f"{rng.randrange(1, 300)} {street}, {town} {number('@@# #@@')}", f"{street} {rng.randrange(1, 99)}, {number('####')} {town}",
            f"{rng.randrange(1, 200)}{pick([',', ' bis,', ' ter,'])} rue {pick(['du', 'de', 'des'])} {street}, {number('#####')} {town}", f"Calle {street} {rng.randrange(1, 300)}, {rng.randrange(1, 9)}.º {pick('ABCD')}, {number('#####')} {town}",
        ])

    def thing() -> str:
        return pick([made_up(), made_up() + " " + pick(sorted(COLOURS)).capitalize(), pick("HFW") + str(rng.randrange(9)), made_up() + "-" + str(rng.randrange(9))])

    def plain() -> str:
        device = pick(["part ##-####", "unit ##.####", "art. ######", "permit ##-####", "series ##/####", "log ###-##-####", "entry ###-#-####", "total ###.###.#### counts", "release ####", "folio ###-####", "archive ########", "asset @@#######", "contract @###.###", "lines ###-####", "job ### ### ####", "track X########"])
        shape = rng.randrange(24)
        some, other = word(), word()
        return [
            f"The {some} of {number(device)} took until {number('##:##')}. ", f"{made_up()} et al. found a {some} of {number('#.##')}. ", f"{thing()} shows a {other} {some} near CX_{number('##')}_{number('####')}. ", f"Many thanks to the {some} team for the {made_up()} {other}. ",
            f"Set {number('##')}@{number('#.##')} before the {some} at{number('##')}. ", f"Tell root@node{rng.randrange(99)} when the {some} stops. ", f"The {thing()} {pick(['Eastern', 'Upper', 'Final', 'Central'])} {some} has {number('##,###')} {other}. ", f"Leave {number(device)} at {number('##')} degrees. ",
            f"Shelf {number('##')}, Hall {number('###')}, keeps the {number(device)} {some}. ", f"{made_up()} {pick(['covers', 'joins', 'raises'])} the {some} of the {other}. ", f"{number('2021-0#-1#')}: {some} replaced, {number(device)}, {other} in May. ", f"Turn to the {made_up()} {pick(['Exercise', 'Theory', 'Method', 'Index'])} and read on. ",
            f"One {some} weighs {number('#.##')} at {number('##')}x. ", f"Mix {number(device)} {pick(['buffer', 'water'])} down to {number('#.##')} mM. ", " ".join(pick([made_up(1, 3).lower()] * 5 + ["of the", "to", "a", "(no ##),", "than ###", "if"]) for _ in range(rng.randint(6, 14))).replace("##", number("##")).upper() + ". ",
            f"{made_up().lower()} {some} {made_up().lower()} the {other} of {made_up().lower()}. ", f"By {number('##')} {some} {made_up()} is dim. ", f"with {made_up().lower()} {other} and {some} over {number('####')}. ", f"{made_up()} {pick(['Blue', 'Red', 'Green', 'Orange'])} and {made_up()}-{rng.randrange(9)} give {some}. ",
            f"For {made_up()}, {made_up()} and {made_up()}, {some} is {number('#.#')}. ", f"The {made_up()} {made_up()} {pick(['test', 'index', 'method', 'stain'])} needs {some}. ", f"{some.capitalize()} {other} {pick(['is', 'was', 'are'])} {number('##.#')} %; {other} {some} is not. ", f"Die {made_up()} mit {number('##')} {made_up()} ist {some}. La {some} {made_up()} vale {number('##')}. ",
            f"to {some} {other}, write {number('###')} lines; call {some} {other} by {some}. ",
        ][shape]

    words = "smaller mitochondria lipid droplets round nuclei vessels proteins objective images portal central water oil area depth ratio signal window sheet method answer report budget garden machine bridge record volume plate table engine market river paper colour figure series border sample curve filter border archive light phase notice window".split()

    def word() -> str:
        return pick(words) if rng.random() < 0.7 else made_up(1, 3).lower()

    named = ["{name} arrived late. ", "I met {name} at the {w}. ", "We asked {name} about the {w} twice. ", "{name} and {name} wrote the {w}. ", "According to {name}, the {w} is new. ", "Dr. {name} leaves on 03.07.2022. ", "Prof. {name} approved the {w}. ", "Mr {name} called again. ", "Mrs. {name} has the {w}. ", "Dear {name}, the {w} came. ", "Yours, {name}\n", "Best regards, {name}\n", "Author: {name}. ", "Supervisor {name} wants another {w}. ",
             "The {w} by {name} won. ", "Talk with {name} about {w}. ", "Signed: {name}. ", "Frau {name} ist krank. ", "Herr {name} hat die {w}. ", "Gespräch mit {name} am Montag. ", "Mme {name} est absente. ", "Lettre de {name} du 4 mai. ", "Sra. {name} llega tarde. ", "Carta de {name}: sin {w}. ", "{name} checked the {w} at 10:15. ", "Technician {name} changed the {w}. ", "Give the {w} to {name} today. ", "cc {name}. "]
    pairs = ["{name}, {phone}. ", "{name} ({email}) has it. ", "{name} | {email} | {phone}\n", "Name: {name}, {id}. ", "{name} ({id}) joined. ", "Guest: Dr. {name}, {address}. ", "Deliver to {name}, {address}. ", "Ask {name} by {phone} or {email}. ", "Lieferung an {name}, {address}. ", "Appeler Mme {name} au {phone}. ", "Avisar a {name}: {email}. ", "Member {name}: {id}, since 1999. ", "{name} lives at {address} now. ", "Write to {name} at {email} soon. ", "Duty: {name}, tel {phone}, mail {email}. ", "Courrier à {name} ({email}) demain. "]
    alone = ["Reach us: {email}. ", "Tel. {phone}. ", "Dial {phone} at night. ", "{id}. ", "Card: {id}. ", "Moved to {address}. ", "Our office: {address}. ", "{email}; {email} ", "Bills go to {email} or {address}. ", "Send it by post to {address}. ", "Kontakt: {email}, {phone}. ", "Adresse : {address}. ", "Copy {email} {email}. ", "He gave {id} and {phone}. "]
    verbs = "saw found kept took sent wants has left moved wrote read likes took opened closed ran made lost said says will checked fixed sold bought knows tested drew cut held met paid gave thinks finds reads owns runs leads".split()
    made = []
    for i in range(sentences):
        text, true = "", set()
        subject = pick(["{name} VERB the {w}. ", "{name} VERB it ({id}). ", "{name} VERB {w} on Friday. "]).replace("VERB", pick(verbs))
        roles = f"{pick(sorted(ROLES)).capitalize()} {subject}"
        patterns = [pick(pick([named, [subject], [roles], pairs, pairs, alone, alone])) for _ in range(2)]
        shout = rng.random() * 0.6
        for pattern in [plain() if rng.random() < 0.6 else "", patterns[0], plain(), patterns[1] if rng.random() < 0.5 else plain(), plain()]:
            for piece in re.split(r"(\{\w+\})", pattern.replace("{w}", word())):
                value = piece
                if piece == "{id}":
                    cue, form = identity()
                    text += cue + " "
                    value = number(form)
                    true.add((2, len(text), len(text) + len(value)))
                elif piece in ("{name}", "{email}", "{phone}", "{address}"):
                    value = {"{name}": name, "{email}": email, "{phone}": phone, "{address}": address}[piece]()
                    true.add((KINDS.index(piece[1:-1]), len(text), len(text) + len(value)))
                if not pattern.count("{") and (shout < 0.06 or shout > 0.57):  # whole sentences in capitals, or in none
                    value = value.upper() if shout < 0.06 else value.lower()
                text += value
        made.append((text, true))
    return made


@lru_cache(1)
def models(sentences: int = TRAINING_SENTENCES, vocabularies: tuple[str, ...] = VOCABULARIES) -> tuple[list[tuple[Trees, float, float, float]], tuple]:
    """For each kind its trees, the two parameters of calibration and the threshold of probability; and the lexicon they were trained with."""
    made, known = training(sentences), lexicon(vocabularies)
    rows, truth, kinds, held = [], [], [], []
    for i, (text, true) in enumerate(made):
        found = spans(text)
        if found:
            rows.append(features(text, found, known))
            kinds += [k for k, _, _ in found]
            truth += [f in true for f in found]
            held += [i % 3 == 0] * len(found)
    x, y, kind, out = np.concatenate(rows), np.array(truth, float), np.array(kinds), np.array(held)
    fitted = []
    for k in range(len(KINDS)):
        use = (kind == k) & ~out
        trees = Trees(x[use], y[use])
        check = (kind == k) & out
        score, true = trees.score(x[check]), y[check]
        slope, shift, target = 1.0, 0.0, (true * true.sum() + 1) / (np.where(true > 0, true.sum(), len(true) - true.sum()) + 2)
        for _ in range(25):  # Newton steps of the calibration sigmoid(slope * score + shift), towards smoothed targets, near slope 1
            p = 1 / (1 + np.exp(-(slope * score + shift)))
            w = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((target - p) * score).sum() - 5 * (slope - 1), (target - p).sum() - shift])
            hess = np.array([[(w * score * score).sum() + 5, (w * score).sum()], [(w * score).sum(), w.sum() + 1]])
            step = np.clip(np.linalg.solve(hess, g), -1, 1)
            slope, shift = max(0.1, slope + step[0]), shift + step[1]
        p = 1 / (1 + np.exp(-(slope * score + shift)))
        grid = np.linspace(0.02, 0.95, 38)
        f1 = [2 * true[p >= t].sum() / max(1, (p >= t).sum() + true.sum()) for t in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        fitted.append((trees, float(slope), float(shift), float(grid[best[len(best) // 2]])))
    return fitted, known


def select(found: list[tuple[int, int, int]], chance: np.ndarray, thresholds: list[float]) -> list[tuple[int, int, int]]:
    """Of the spans above their thresholds, without overlap, the likeliest, then the longest."""
    order = sorted((i for i, (k, _, _) in enumerate(found) if chance[i] >= thresholds[k]), key=lambda i: (-round(float(chance[i]), 3), found[i][1] - found[i][2], found[i]))
    kept: list[tuple[int, int, int]] = []
    for i in order:
        _, a, b = found[i]
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append(found[i])
    return sorted(kept, key=lambda f: f[1])


def detect(texts: list[str], fitted: tuple | None = None) -> list[list[tuple[int, int, int]]]:
    """The selected spans of each text; the texts are scored together."""
    fitted, known = fitted or models()
    proposed = [spans(t) for t in texts]
    some = [features(t, f, known) for t, f in zip(texts, proposed) if f]
    if not some:
        return [[] for _ in texts]
    x = np.concatenate(some)
    kind = np.array([k for f in proposed for k, _, _ in f])
    chance = np.zeros(len(kind))
    for k, (trees, slope, shift, _) in enumerate(fitted):
        use = np.flatnonzero(kind == k)
        if len(use):
            chance[use] = 1 / (1 + np.exp(-(slope * trees.score(x[use]) + shift)))
    out, at = [], 0
    for f in proposed:
        out.append(select(f, chance[at : at + len(f)], [t[3] for t in fitted]))
        at += len(f)
    return out



def redact(documents: DataFrame, id_column: str, text_column: str, chunk: int = 4096) -> DataFrame:
    """(id, redacted, found) of each document: its text with placeholders such as [EMAIL], and the pieces as an array of (kind, text).

    White space within a piece counts as one blank in `found`. Null texts stay null with no pieces; empty texts stay empty. Every row is
    handled by itself, whole, and nothing is shuffled. Other columns are ignored.
    """
    spark = documents.sparkSession
    fitted = spark.sparkContext.broadcast(models())
    texts = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    schema = "id long, redacted string, found array<struct<kind:string,text:string>>"
    piece = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, chunk):
                part = batch.slice(c, chunk)
                raw = part.column("text").to_pylist()
                clean, pieces = [], []
                for text, kept in zip(raw, detect([t or "" for t in raw], fitted.value)):
                    out, at, got = [], 0, []
                    for k, a, b in kept:
                        out += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = b
                        got.append({"kind": KINDS[k], "text": " ".join(text[a:b].split())})
                    clean.append(None if text is None else "".join(out) + text[at:])
                    pieces.append(got)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(clean, pa.string()), pa.array(pieces, piece)], ["id", "redacted", "found"])

    return texts.mapInArrow(work, schema)
