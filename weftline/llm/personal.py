"""Problem 10: personal information inside free text.

Method: regular expressions propose spans with a base score, checksum
validators (Luhn, mod 97, mod 11-10, mod 23) confirm them, and context words
near a span raise or lower the score; spans at or above ``THRESHOLD`` that do
not overlap a better one are kept. Names are proposed as runs of capitalised
words; a known part of a name (table ``name_parts``), a title, or the words
around decide.

Plan. One narrow Arrow stage over the documents: no shuffle. The table of known
name parts (a few dozen rows, its size is checked) is the only thing broadcast.
Whole texts are scanned, whatever their length.

Kinds: ``email`` (also spelt out; not a login or remote), ``phone``,
``id_number``, ``address``, ``name``.

Defined results: a null text stays null and has no finds; an empty text stays
empty; repeated rows come out as often as they come in; ``line_no`` counts lines
split at ``\\n`` from 1 and is the line a find begins on; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Most rows of known name parts that are sent to the executors.
MOST_PARTS = 100_000

SEP = r"(?:[ \t]|[ \t]?\r?\n[ \t]{0,8})"


# --- checksums -------------------------------------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The last two digits are 97 minus the rest modulo 97 (social insurance numbers of 15 digits)."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def mod11_10(digits: str) -> bool:
    """ISO 7064 mod 11,10, used by tax numbers of 11 digits."""
    p = 10
    for c in digits[:-1]:
        p = ((p + int(c)) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def mod23(digits: str, letter: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter.upper()


# --- patterns --------------------------------------------------------------------------------------------------------
LOCAL = re.compile(r"[A-Za-z0-9._%+\-]+\Z", re.A)
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", re.A)
AT = r"[ \t]*(?:\(at\)|\[at\]|\{at\})[ \t]*"
DOT = r"(?:[ \t]*(?:\(dot\)|\[dot\]|\{dot\})[ \t]*|[ \t]+dot[ \t]+|\.)"
SPELT = re.compile(rf"[A-Za-z0-9._%+\-]+(?:{AT}[A-Za-z0-9\-]+(?:{DOT}[A-Za-z0-9\-]+)+|[ \t]+at[ \t]+[A-Za-z0-9\-]+(?:[ \t]+dot[ \t]+[A-Za-z0-9\-]+)+)", re.A | re.I)
SPELT_SIGNS = ("(at)", "[at]", "{at}", " dot ", "(AT)", "[AT]", "{AT}", " DOT ")
LOGIN_BEFORE = re.compile(r"(?:\bssh|\bscp|\brsync|\bsftp)[ \t]+(?:-\S+[ \t]+)*\Z")

#: Digits with separators: every phone and most identity numbers look like this.
NUMBER = re.compile(r"(?<![\w.])(?:\+|\()?\d(?:[\d]|[ \-./()](?=[\d( ])){5,24}\d(?:-?[A-Za-z])?(?![\w])", re.A)
PHONES = [  # pattern of the whole number, base score
    (re.compile(r"\+\d{1,3}[ \-./]?(?:\(0\)[ ]?)?\d[\d \-./()]{5,16}\d"), 0.7),
    (re.compile(r"00\d{1,3}[ \-./](?:\(0\)[ ]?)?\d{1,5}[ \-./]\d[\d \-./]{3,12}\d"), 0.6),
    (re.compile(r"\(\d{3}\) ?\d{3}[\-. ]\d{4}"), 0.7),
    (re.compile(r"\d{3}([\-.])\d{3}\1\d{4}"), 0.6),
    (re.compile(r"(?:1[\-. ])?\d{3} \d{3} \d{4}"), 0.35),
    (re.compile(r"0\d{2} \d{4} \d{4}"), 0.6),
    (re.compile(r"0\d{3,4} \d{3} ?\d{3,4}"), 0.6),
    (re.compile(r"\(0\d{2,4}\) ?\d{3,4} ?\d{3,4}"), 0.6),
    (re.compile(r"0\d{1,4}[/\-]\d{5,8}"), 0.4),
    (re.compile(r"0\d(?:[ .]\d\d){4}"), 0.5),
    (re.compile(r"0\d{1,3}-\d{2,4}-\d{4}"), 0.5),
    (re.compile(r"1?[2-9]\d{9}|\d{9,11}"), 0.15),
]
EXTENSION = re.compile(r"[ ]*(?:ext\.?|x)[ ]*\d{1,5}\b", re.I)
PHONE_CONTEXT = re.compile(r"(?:@[\w.\-]+,\Z|phone|\btel|\bcall|mobile|\bfax|support|hotline|telefon|anruf|rufnummer|téléphone|appel|teléfono|llam|móvil|電話)", re.I)

ID_LETTERED = re.compile(r"(?<![\w])(?:[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|[A-Z]{1,2}\d{3}[ ]?\d{4,6})(?![\w])", re.A)
NI = re.compile(r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]")
IDS = [
    (re.compile(r"\d{3}-\d{2}-\d{4}"), 0.6),
    (re.compile(r"\d{4}/\d{2}-\d{5}"), 0.3),
    (re.compile(r"\d{2} \d{3} \d{3} \d{3}"), 0.25),
    (re.compile(r"\d{3} \d{3} \d{3}"), 0.1),
    (re.compile(r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"), 0.2),
    (re.compile(r"\d{8}-?[A-Z]"), 0.3),
    (re.compile(r"\d{6,8}-\d{4}"), 0.1),
    (re.compile(r"\d{8,12}"), 0.0),
]
ID_CONTEXT = re.compile(
    r"(?:(?<![A-Za-z])ssn(?![A-Za-z])|social|insurance|passport|passeport|pasaporte|reisepass|national id|tax id|tax no|identity|(?<![A-Za-z])(?:ni number|nino|dni|nie|nif|nir)(?![A-Za-z])|ausweis|steuer|sécu|carte d.identité|personnummer|マイナンバー|旅券)",
    re.I,
)

CAP = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
STREET_EN = r"(?:Road|Rd\.?|Street|St\.?|Lane|Ln\.?|Close|Terrace|Avenue|Ave\.?|Drive|Dr\.?|Court|Square|Way|Crescent|Row|Hill|Gardens|Place|Boulevard|Blvd\.?|Mews|Walk|Grove|Quay|Parade)"
#: What may follow street and house: flat, floor and door, post code and town.
TAIL = rf"(?:,{SEP}(?:Flat{SEP}?\d+[a-z]?|\d{{1,2}}\.?[ºª°]{SEP}?[A-Z]?(?![\w])|\d{{4,5}}{SEP}{CAP}|{CAP}(?:[ ]{CAP})?))*"
HERE = r"(?<![A-Za-z0-9À-ɏ_.,/\-])"
STREET_FR = r"(?:rue|avenue|allée|chemin|impasse|place|quai|boulevard|cours|route|square|sentier|passage|ruelle|venelle)"
STREET_DE = r"(?:straße|strasse|str\.|weg|allee|stieg|gasse|platz|ring|damm|ufer|wall|graben|chaussee|pfad|steig)"
STREET_ES = r"(?:Calle|C/|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía|Carrera|Cuesta|Rua|Travessa|Largo|Praça|Alameda)"
#: Patterns that begin with a house or street, each with the words one of which it must hold.
ADDRESSES = [
    (re.compile(rf"{HERE}\d{{1,4}}[a-z]?,?{SEP}(?:{CAP}{SEP}){{1,3}}{STREET_EN}(?![\w(]){TAIL}"), "en"),
    (re.compile(rf"{HERE}\d{{1,4}}(?:{SEP}?(?:bis|ter|quater))?,?{SEP}(?i:{STREET_FR})(?:{SEP}(?:de|du|des|la|le|les|à|aux))*{SEP}(?:[dl]['’])?{CAP}(?:[ ]{CAP})*{TAIL}"), "fr"),
    (re.compile(rf"{HERE}(?:{CAP}{SEP}){{0,2}}(?:[A-ZÄÖÜ][\wäöüß\-]*{STREET_DE}|(?:Straße|Weg|Allee|Gasse|Platz|Ring|Damm)){SEP}\d{{1,4}}[a-z]?(?![A-Za-z0-9_]){TAIL}"), "de"),
    (re.compile(rf"{HERE}(?:{CAP}{SEP}){{1,4}}\d{{1,4}}[a-z]?,{SEP}\d{{5}}{SEP}{CAP}"), "code"),
    (re.compile(rf"{HERE}{STREET_ES}(?:{SEP}(?:de|del|la|las|los|el|da|do|das|dos))*(?:{SEP}{CAP}){{1,4}},?{SEP}(?:n\.?º{SEP}?)?\d{{1,4}}(?![A-Za-z0-9_]){TAIL}"), "es"),
    (re.compile(r"[一-龥ァ-ヶ]{1,6}[都道府県][一-龥ァ-ヶぁ-ん]{1,8}[市区町村郡][^\s、。]{0,12}?\d{1,4}(?:丁目|番地|番|-\d)"), "ja"),
]
CODE_SIGN = re.compile(rf",{SEP}\d{{5}}[ \t\r\n]")
#: The words, by pattern; where one stands, its surroundings are matched.
WORDS = {
    "en": "Road Rd Street St Lane Ln Close Terrace Avenue Ave Drive Dr Court Square Way Crescent Row Hill Gardens Place Boulevard Blvd Mews Walk Grove Quay Parade".split(),
    "fr": "rue avenue allée chemin impasse place quai boulevard cours route square sentier passage ruelle venelle Rue Avenue Allée Chemin Place Quai Boulevard Cours Route".split(),
    "de": "straße strasse str. weg allee stieg gasse platz ring damm ufer wall graben chaussee pfad steig Straße Weg Allee Gasse Platz Ring Damm".split(),
    "es": "Calle C/ Avda Av. Avenida Plaza Pza Paseo Camino Ronda Travesía Carrera Cuesta Rua Travessa Largo Praça Alameda".split(),
    "ja": "都 道 府 県".split(),
}
#: Characters before and after a street word that a pattern may take in.
REACH = 120


@lru_cache(maxsize=1)
def _street_words() -> ahocorasick.Automaton:
    words: dict[str, list[str]] = {}
    for lang, some in WORDS.items():
        for w in some:
            keys = [w + c for c in " \n\r\t"] if lang in ("fr", "de") else [f"{c}{w}" for c in " \n\t"] if lang == "en" else [w]
            for k in keys:
                words.setdefault(k, []).append(lang)
    a = ahocorasick.Automaton()
    for k, langs in words.items():
        a.add_word(k, tuple(langs))
    a.make_automaton()
    return a


#: Capital and small letters of Latin with all its extensions.
UP = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isupper())
LOW = "".join(c for c in map(chr, range(0x61, 0x250)) if c.islower())
WORD = rf"[{UP}][{LOW}]+(?:['’\-][{UP}]?[{LOW}]+)*"
UPPER = rf"[{UP}]{{2,}}(?:-[{UP}]{{2,}})*(?![A-Za-zÀ-ɏ0-9_(])"
PARTICLE = r"(?:van|von|de|der|den|del|della|da|di|du|la|le|ten|ter|zu|zur|dos|bin|al)"
TOKEN = rf"(?:{WORD}|{UPPER}|[{UP}]\.)"
RUN = re.compile(rf"(?<![A-Za-zÀ-ÖØ-öø-ɏ0-9_.]){TOKEN}(?:,?{SEP}(?:{PARTICLE}{SEP}){{0,2}}{TOKEN})+")
PIECE = re.compile(rf"({TOKEN})|({PARTICLE})(?={SEP})|(,)")
TITLE = {"dr.", "dr", "mr.", "mr", "mrs.", "mrs", "ms.", "ms", "mx.", "prof.", "prof", "herr", "frau", "mme", "mme.", "mlle", "monsieur", "madame", "sr.", "sra.", "sr", "sra", "don", "doña", "señor", "señora", "sir", "dame", "rev."}
#: Capitalised words that begin sentences or label lines; never a part of a name.
PLAIN = {
    "ask", "as", "thanks", "merci", "gracias", "author", "the", "part", "from", "to", "cc", "by", "hinweis", "reported", "dear", "hi", "hello", "and", "for", "with", "todo", "fixme", "parcel",
    "on", "please", "see", "das", "der", "die", "el", "la", "le", "les", "los", "un", "une", "merge", "revert", "update", "release", "copyright", "contact", "danke", "an", "bitte", "am", "im",
    "gemeldet", "signalé", "avisado", "betroffen", "cas", "caso", "reportado", "user", "name", "owner", "create", "select", "from", "where", "join", "using", "values", "insert", "into", "set", "note", "page", "project", "view", "authors", "questions", "dudas", "per", "when", "if", "old", "new",
}
BEFORE = re.compile(
    r"(?:(?:\bAuthor|\bCommitter|-by|\bCc|\bBcc|\bFrom|\bTo|\bowner|\bname|\bmaintainer|\bcontact|\bassignee|\breviewer|\bauthor|\buser|\bclient|\bcustomer|\bNom|\bNombre)[\"']?\s*[:=]\s*[\"'(]?"
    r"|\b(?:by|Ask|ask|As|Thanks to|thanks to|and to|Merci à|merci à|Gracias a|gracias a|Hinweis von|Dank an|von|par|por|Cas de|Caso de|[Bb]etroffen war|[Bb]etrifft|[Nn]ote:|Rückfragen an|contact|called|named|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herr|Frau|Mme|M\.)[ \t]"
    r"|User\([\"']|VALUES \(\d+, ['\"]|<td>|^[+\- ]?\s*\d+,)\Z",
    re.M,
)
AFTER = re.compile(
    r"\s{0,2}(?:[<(][\w.+\-]+(?:@|\(at\)| ?\[at\]| at )|,[\w.+\-]+(?:@|\(at\)| \[at\])|\s?さん|\s?氏|\s?様|wrote\b|pointed out\b|for the \w+|if in doubt|over the phone|said\b|reported\b|asked\b|noted\b|,?[ ](?:t[ée]l|Tel|phone)\b|[ ,]{1,2}\(?(?:ssn|SSN|passport|passeport|Ausweis|tax|national|NI|DNI|NIE|QQ|\d{3})[^A-Za-z]{0,1}|pour l|por l|por el|für d|"
    r"</td><td>|[\"']?, ?[\"']?(?:mail|email|tel|ssn|phone)\b|[\"'], (?:ssn|[\"']))"
)


#: A label before, or words after, that stand with a person only.
LABEL = re.compile(r"(?:\bAuthor|\bCommitter|-by|\bowner|\bmaintainer|\bassignee|\breviewer|\bauthor)[\"']?\s*[:=]\s*[\"'(]?\Z")
SURE_AFTER = re.compile(r"\s{0,2}(?:[<(][\w.+\-]+(?:@|\(at\)| ?\[at\]| at )|,[\w.+\-]+(?:@|\(at\)| \[at\])|\s?さん|\s?氏|\s?様|wrote from|pointed out\b|over the phone)")


def propose_emails(text: str) -> Iterator[tuple[int, int, str, float]]:
    at = text.find("@")
    while at >= 0:
        left = LOCAL.search(text, max(0, at - 80), at)
        right = DOMAIN.match(text, at + 1)
        if left and right:
            b, e = left.start(), right.end()
            while b < at and text[b] in "._-%+":
                b += 1
            score = 0.8 if b < at else 0.0
            token = text[max(0, b - 120) : b]
            token = token[max(token.rfind(c) for c in " \t\n\"'<(") + 1 :]
            if "://" in token or LOGIN_BEFORE.search(text, max(0, b - 40), b):
                score -= 0.8  # a login in an address
            if text[e : e + 1] in (":", "/") and text[e + 1 : e + 2].strip():
                score -= 0.8  # a remote
            yield b, e, "email", score
        at = text.find("@", at + 1)
    if any(x in text for x in SPELT_SIGNS):
        for m in SPELT.finditer(text):
            yield m.start(), m.end(), "email", 0.7


def propose_numbers(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in NUMBER.finditer(text):
        b, e = m.span()
        if text[b] == "+" and (b == 0 or text[b - 1] == "\n"):
            b += 1  # the mark of an added line
        if text[b] == "(" and ")" not in text[b:e]:
            b += 1
        s = text[b:e].rstrip(" -./(")
        e = b + len(s)
        digits = re.sub(r"\D", "", s)
        near = text[max(text.rfind("\n", 0, b) + 1, b - 48) : b]
        follow = text[e : e + 24].split("\n", 1)[0]
        phone_word, id_word = bool(PHONE_CONTEXT.search(near) or PHONE_CONTEXT.search(follow)), bool(ID_CONTEXT.search(near[-32:]))
        best: tuple[float, str] = (0.0, "")
        if not s[-1].isalpha():
            for rx, score in PHONES:
                if rx.fullmatch(s) and 8 <= len(digits) <= 15:
                    best = max(best, (score + 0.4 * phone_word - 0.4 * id_word, "phone"))
                    break
        for rx, score in IDS:
            if rx.fullmatch(s):
                if s[-1].isalpha():
                    score += 0.3 * mod23(digits, s[-1])
                elif len(digits) == 15:
                    score += 0.4 * mod97(digits)
                elif len(digits) == 11:
                    score += 0.15 * mod11_10(digits)
                elif len(digits) in (9, 10):
                    score += 0.1 * luhn(digits)
                best = max(best, (score + 0.5 * id_word - 0.2 * phone_word, "id_number"))
                break
        if best[1]:
            if best[1] == "phone" and (x := EXTENSION.match(text, e)):
                e = x.end()
            yield b, e, best[1], best[0]
    for m in ID_LETTERED.finditer(text):
        b = m.start()
        near = text[max(text.rfind("\n", 0, b) + 1, b - 32) : b]
        yield b, m.end(), "id_number", (0.5 if NI.fullmatch(m[0]) else 0.1) + 0.5 * bool(ID_CONTEXT.search(near))


def propose_addresses(text: str) -> Iterator[tuple[int, int, str, float]]:
    near: dict[str, list[list[int]]] = {}
    hits = [(end, langs) for end, langs in _street_words().iter(text)]
    hits += [(m.start(), ("code",)) for m in CODE_SIGN.finditer(text)]
    for end, langs in hits:
        for lang in langs:
            spans = near.setdefault(lang, [])
            if spans and end - REACH <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end + REACH)
            else:
                spans.append([max(0, end - REACH), end + REACH])
    for rx, lang in ADDRESSES:
        for b, e in near.get(lang, ()):
            for m in rx.finditer(text, b, e):
                yield m.start(), m.end(), "address", 0.75


class Names:
    """Names from runs of capitalised words; ``given`` and ``family`` hold the known parts in lower case."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family

    def known(self, word: str) -> tuple[bool, bool]:
        w = word.casefold()
        parts = {w, *w.split("-")}
        return bool(parts & self.given), bool(parts & self.family)

    def propose(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for run in RUN.finditer(text):
            base = run.start()
            toks: list[tuple[int, int, str]] = []  # begin, end, text; a comma or particle keeps its own entry
            for m in PIECE.finditer(run[0]):
                toks.append((base + m.start(), base + m.end(), m[0]))
            i = 0
            while i < len(toks):
                titled = False
                while i < len(toks) and toks[i][2].casefold() in TITLE:
                    titled, i = True, i + 1
                took = self._at(text, toks, i, titled)
                if took:
                    j, score = took
                    yield toks[i][0], toks[j][1], "name", score
                    i = j + 1
                else:
                    i += 1

    def _at(self, text: str, toks: list[tuple[int, int, str]], i: int, titled: bool) -> tuple[int, float] | None:
        """The end and score of the best name that begins at token ``i``."""
        if i >= len(toks) - 1 + titled:
            return None
        first = toks[i][2] if i < len(toks) else ""
        if not first or first == "," or first.casefold() in PLAIN or not first[0].isupper():
            return None
        found: tuple[int, float] | None = None
        comma = i + 1 < len(toks) and toks[i + 1][2] == ","
        if comma:
            ends = [i + 2] if i + 2 < len(toks) and len(first) > 2 else []
            if ends and i + 3 < len(toks) and re.fullmatch(r"[A-ZÀ-Þ]\.", toks[i + 3][2]):
                ends.append(i + 3)
        else:
            j, ends = i + 1, []
            while j < len(toks) and j <= i + 4 and (re.fullmatch(r"[A-ZÀ-Þ]\.", toks[j][2]) or toks[j][2][0].islower()):
                j += 1
            if j < len(toks) and j <= i + 4 and toks[j][2] != ",":
                ends.append(j)
            elif titled:
                ends.append(i)
        for j in ends:
            words = [t[2] for t in toks[i : j + 1] if t[2] != "," and not t[2][0].islower()]
            last = words[-1]
            if last.casefold() in PLAIN or (len(words) > 1 and words[0].isupper() and len(words[0]) > 2 and not (last.isupper() or last.endswith("."))):
                continue
            if comma and last.endswith("."):
                last = words[-2]
            g1, f1 = self.known(first)
            g2, f2 = self.known(last)
            if comma:
                g, f = g2, f1
            else:
                g, f = g1, f2
            initial = len(first) == 2 and first.endswith(".")
            score = 0.4 * g + 0.4 * f + 0.3 * titled
            if not (g or f) and (g1 or f1 or g2 or f2):
                score += 0.3
            if initial and f:
                score += 0.15
            before = bool(BEFORE.search(text, max(0, toks[i][0] - 40), toks[i][0]))
            after = bool(AFTER.match(text, toks[j][1]))
            score += 0.3 * before + 0.3 * after
            score += 0.2 * bool(LABEL.search(text, max(0, toks[i][0] - 40), toks[i][0])) + 0.2 * bool(SURE_AFTER.match(text, toks[j][1]))
            if before and not after and not (g or f) and not titled and not comma:
                score += 0.2 * (text[toks[j][1] : toks[j][1] + 1] in ("", "\n", "\r", " ", ".", ",", ":", '"', "'", "<"))
            if (g or f) and not before and not after:
                score += 0.15
            if found is None or score > found[1]:
                found = (j, score)
        return found if found and found[1] >= THRESHOLD else None


def find(text: str | None, names: Names) -> list[tuple[int, int, str, float]]:
    """Spans ``(begin, end, kind, score)`` in order, without overlaps; the better score wins, then the longer span."""
    if not text:
        return []
    spans = [s for part in (propose_emails(text), propose_numbers(text), propose_addresses(text), names.propose(text)) for s in part if s[3] >= THRESHOLD]
    if len(spans) < 2:
        return spans
    order = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}
    kept: list[tuple[int, int, str, float]] = []
    begins: list[int] = []
    for s in sorted(spans, key=lambda s: (order[s[2]], -s[3], s[0] - s[1], s[0])):
        k = bisect_right(begins, s[0])
        if (k and kept[k - 1][1] > s[0]) or (k < len(kept) and kept[k][0] < s[1]):
            continue
        kept.insert(k, s)
        begins.insert(k, s[0])
    return kept


def masked(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for b, e, kind, _ in spans:
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    out.append(text[at:])
    return "".join(out)


def _scanner(parts, key: str, text: str, lines_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, family = parts.value
        names = Names(given, family)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            if lines_only:
                at, line, kind = [], [], []
                for k, t in enumerate(texts):
                    seen = set()
                    for b, _, what, _ in find(t, names):
                        hit = (t.count("\n", 0, b) + 1, what)
                        if hit not in seen:
                            seen.add(hit)
                            at.append(k)
                            line.append(hit[0])
                            kind.append(what)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, type=pa.int64())), pa.array(line, type=pa.int32()), pa.array(kind, type=pa.string())], names=[key, "line_no", "kind"])
            else:
                out, found = [], []
                for t in texts:
                    spans = find(t, names)
                    out.append(masked(t, spans))
                    found.append([{"kind": k, "line_no": t.count("\n", 0, b) + 1, "begin": b, "length": e - b, "score": s} for b, e, k, s in spans])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("line_no", pa.int32()), ("begin", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(out, type=pa.string()), pa.array(found, type=kind)], names=[key, "masked_text", "finds"])

    return run


def _parts(name_parts: DataFrame):
    n = name_parts.count()
    if n > MOST_PARTS:
        raise ValueError(f"{n} known name parts; at most {MOST_PARTS} are sent to the executors")
    rows = name_parts.select("part_kind", F.lower(F.trim("name_part")).alias("p")).filter(F.length("p") > 1).distinct().collect()
    given, family = {r.p for r in rows if r.part_kind == "given"}, {r.p for r in rows if r.part_kind == "family"}
    return name_parts.sparkSession.sparkContext.broadcast((given, family))


def found_lines(df: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, kind``: one row for each kind of personal data that begins on a line."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(_scanner(_parts(name_parts), key, text, True), f"`{key}` {kind}, line_no int, kind string")


def redact(df: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, masked_text, finds``: the text with typed placeholders and the list of what was found."""
    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, masked_text string, finds array<struct<kind: string, line_no: int, begin: int, length: int, score: double>>"
    return df.select(key, text).mapInArrow(_scanner(_parts(name_parts), key, text, False), out)
