"""Personal information in free text, found and replaced by typed placeholders.

Method: anchor expansion. One Aho-Corasick scan finds the anchors: at-signs (also written out),
schemes, digits and plus signs, digit words, street words, titles, known names and parts that
several known names share, and the cues of identity numbers, phones, addresses and names. At
each anchor a local parser expands to both sides and validates what it finds: the parts of an
e-mail address, the shape of a street line, the plan of a phone number, the check digits of a
number, the form of a name. A number without a cue must pass its check (Luhn, mod 97, check
letter) or have a shape that nothing technical has; behind a cue its shape is enough, as a
mistyped identity number is personal too.

Names: a word is known (in the lexicon) or like a name (a naive Bayes classifier over letter
groups, fitted on the lexicon against the different words of all documents). Two name words
together, a title with a name word, or a cue with what its strength asks for make a person.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.lookalike import _INVISIBLE, _TO_LATIN

KINDS = ("email", "phone", "idnum", "address", "name")
#: Words, and characters of them, that a task keeps so as to give each of them once.
MET_WORDS, MET_CHARS = 300_000, 10_000_000
#: Most names of the lexicon, which is sent to every task.
MOST_NAMES = 200_000

# Cues in the languages of the corpus, in lower case.
_AT = ("@", "[at]", "(at)", " at ", "{at}", "%40")
_ID_CUES = (
    "passport", "tax id", "tax number", "identity number", "identity card", "id card", "driving licence", "driver's license", "driving license", "ssn", "social security", "national insurance",
    "steuer-id", "steuernummer", "ausweisnummer", "ausweis-nr", "reisepass", "personalausweis", "führerschein", "carte d'identité", "passeport", "permis de conduire", "sécurité sociale",
    "documento de identidad", "dni", "nie", "nif", "pasaporte", "carné de conducir",
)
_PHONE_CUES = (
    "tel", "phone", "mobile", "fax", "call me", "number is", "call ", "text ", "reach ", "dial ", "tel:", "sms:", "callto:", "telefon", "handy", "rufen sie", "tél", "téléphone", "appelez", "portable", "teléfono", "llame", "móvil", "whatsapp",
)
_ADDRESS_CUES = ("live at", "lives at", "moved to", "goes to", "address", "adresse", "wohnhaft", "wohnt", "habite", "vive en", "dirección", "domicilio", "anschrift", "living at", "resides at")
# What introduces a name. Behind a strong cue stands nothing but a name; one of
# attribution may name a group instead; a weak one speaks of a person but may go on otherwise; a
# loose one may introduce anything, so that a word known or like a name must follow.
_STRONG = (
    "my name is", "my name's", "his name is", "her name is", "name:", "transcribed by", "mein name ist", "ich heiße", "sein name ist", "ihr name ist", "transkribiert von", "je m'appelle", "je m’appelle", "mon nom est", "transcrit par",
    "me llamo", "mi nombre es", "se llama", "transcrito por",
)
_BY = tuple(
    f"{v} {p}" for p, verbs in {"by": "read spoken narrated written recorded presented hosted edited translated signed", "von": "gesprochen gelesen geschrieben vorgelesen erzählt", "par": "lu dit écrit raconté présenté", "por": "leído escrito narrado presentado"}.items() for v in verbs.split()
)
_WEAK = (
    *(f"{r} {v}" for r in ("reader", "speaker", "narrator", "host", "guest", "author", "interviewer", "transcriber", "teacher") for v in ("is", "was")),
    "i am", "i'm", "i’m", "thank you", "thanks", "dear", "hello", "hi", "regards", "sincerely", "signed", "interview with", "interviewed", "spoke with", "spoke to", "talked to",
    "ich bin", "hier spricht", "danke", "liebe", "lieber", "gespräch mit", "interview mit", "je suis", "merci", "entretien avec", "soy", "habla", "gracias", "querida", "querido", "entrevista con",
)
_LOOSE = ("this is", "with", "met", "asked", "told", "contact", "hier ist", "fragte", "traf", "c'est", "c’est", "rencontré", "conocí a")
_CUE = {c: 1 for c in _LOOSE} | {c: 2 for c in _WEAK} | {c: 3 for c in _BY} | {c: 4 for c in _STRONG}
_TITLES = tuple("dr mr mrs ms miss prof professor sra sr srta señor señora señorita don doña frau herr mme mlle madame monsieur mademoiselle sir lady rev m".split())
#: Titles that are also plain words, and so stand as titles only with a capital before another
#: (the Spanish one without).
_ALSO_WORDS = frozenset(("m", "don", "sir", "lady", "miss", "rev"))
#: After a name that a weak cue introduces: the person speaks.
_SPEAKS = re.compile(r"\s+(?:speaking|am apparat|à l'appareil|al habla)\b")
# Words that are no part of a name, whatever stands before them.
_COMMON = frozenset(
    "the a an our their this that these those some every my your his her its each any no one and or but if so as of in on at to for from by with about after before very much all everyone everybody both again then now here there not just only "
    "we you i he she it they who what when where why how is was are were be been will would can could also guys folks team sir madam ladies gentlemen friends colleagues speaking radio good morning evening afternoon "
    "der die das den dem des ein eine einen und oder aber wenn als auf mit zu für von vom nicht sehr auch alle ich du er sie es wir ihr ist war sind unter über nach vor le la les l un une des du de et ou mais si comme dans sur avec pour par pas très tous je tu il elle nous vous ils "
    "est sont el los las una unos y o pero como en con para por muy todos yo tú él ella nosotros es son sobre sin cuando".split()
)
#: Words of the cues themselves, which are no names either.
_OTHER_CUES = frozenset(w for c in (*_ID_CUES, *_PHONE_CUES, *_ADDRESS_CUES) for w in c.split())
_CUE_WORDS = _OTHER_CUES | {w for c in _CUE for w in c.split()}
_FIXED_WORDS = _COMMON | _CUE_WORDS
_STREET_EN = r"(?:street|st\.|avenue|ave\.?|road|rd\.|lane|court|drive|boulevard|blvd\.?|square|terrace|crescent|close|way|place)"
_DIGIT_WORDS = tuple(
    "zero oh one two three four five six seven eight nine double triple null eins zwei drei vier fünf sechs sieben acht neun "
    "zéro un deux trois quatre cinq six sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve".split()
)
# Words beside a name that make it that of a corpus, recipe, tool or place.
_THING = r"(?:corpus|corpora|recipe|dataset|data\s+set|toolkit|tool|model|set|library|street|road|lane|court|ave|avenue|place|city|town|island|river|university|institute)"
_NOT_A_PERSON = re.compile(r"\s+" + _THING + r"\b")
_THINGS = frozenset(_THING[3:-1].split("|"))
# Plain words before a spoken "at" that goes on to a site, not to a mailbox.
_NO_MAILBOX = frozenset("noon midnight night us me him them look looking meet met see seen find found visit available online live site website page homepage blog shop here there read more is are was were back home and or".split())

_LOCAL = re.compile(r"[a-z0-9](?:[a-z0-9._%+\-]*[a-z0-9])?$")
_LOCAL_SPOKEN = re.compile(r"[a-z0-9][a-z0-9_%+\-.]*(?:(?:\s+(?:dot|underscore|dash|hyphen|minus|plus)\s+|\s*[\[({](?:dot|underscore)[\])}]\s*)[a-z0-9][a-z0-9_%+\-]*)*$")
_DOMAIN = re.compile(r"(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+[a-z]{2,}(?![a-z0-9])")
_DOMAIN_SPOKEN = re.compile(r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:(?:\s+dot\s+|\s*[\[({]dot[\])}]\s*|\.)[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*(?:\s+dot\s+|\s*[\[({]dot[\])}]\s*)[a-z]{2,}(?![a-z0-9])")

# A break between digits; a line break before a line's number or a cue's number is none.
_SEP = r"(?:[ .\-]|\s?\n(?!\d+[ \t]*[\t\n]))"
_PHONE_SHAPES = re.compile(
    r"(?<![\w.:/@+\-])(?:"
    rf"\+[1-9]\d{{0,2}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d(?:{_SEP}?\d){{6,12}}"
    rf"|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}"
    r"|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}"
    rf"|0\d{{4}}{_SEP}\d{{6}}|0\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}|0\d{{2}}{_SEP}\d{{4}}{_SEP}\d{{4}}"
    r"|0[1-9](?:[ .]\d{2}){4}|0\d{2,4}/\d{5,9}"
    r"|00[1-9]\d{8,12}"
    r")(?:\s*(?:ext\.?|extension|x|durchwahl|poste)\s*\d{1,5})?(?![\w@]|[.\-:]\d)"
)
_PHONE_AFTER_CUE = re.compile(rf"(?<![\w.])[+(]?\d(?:(?:{_SEP}|[/()]){{0,3}}\d){{6,14}}(?![\w@]|[.\-:]\d)")
_SPOKEN_DIGITS = re.compile(r"\b(?:(?:%s)[\s,\-]+){6,}(?:%s)\b" % (("|".join(_DIGIT_WORDS),) * 2))

_ID_LEAD = re.compile(r"[\s:#.,]*(?:(?:no|nr|nº|n°|num|number|numéro|número|id|is|of|the|reader|card|licence|ist|est|es)\b[\s:.#º°]*){0,6}")
_ID_SHAPES = re.compile(
    r"(?:\d{4}\s\d{4}\s\d{4}|\d{3}-\d{2}-\d{4}|[a-z]-\d{3}\s\d{3}\s\d{2}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}|[a-z]{1,6}[\-\s]?\d{5,12}[a-z0-9]{0,4}|\d{7,14}[a-z]?"
    r"|[a-z]{0,3}[\-\s]?\d[\da-z]*(?:[ .\-/]\d[\da-z]*){1,5})(?![\w])"
)

_STREETS = {
    "en": re.compile(r"(?<![\w.\-:/])[1-9]\d{0,4}[a-z]?,?\s+(?:[^\W\d_][\w'’\-]*\s+){1,3}?" + _STREET_EN + r"(?!\w)(?:,?\s+(?:apt\.?|flat|unit|suite|no\.?)\s*\w+)?(?:,\s+[^\W\d_][\w\-]*(?:\s+\d{4,6}\b)?)?"),
    "de": re.compile(r"(?<!\w)[^\W\d_]{3,}(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer)\s+\d{1,4}(?:\s?[a-z])?(?!\w)(?:,\s+\d{5}\s+[^\W\d_][\w\-]*)?"),
    "fr": re.compile(r"(?<![\w.\-:/])[1-9]\d{0,3}(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|place|boulevard|allée|impasse|chemin|quai)\s+(?:(?:de|du|des|la|le|l')\s*){0,2}[^\W\d_][\w\-]*(?:,\s+\d{5}\s+[^\W\d_][\w\-]*)?"),
    "es": re.compile(r"(?<!\w)(?:calle|c/|plaza|avda\.?|avenida|paseo)\s+(?:(?:de|del|la|el|los|las)\s+){0,2}[^\W\d_][\w\-]*,?\s+\d{1,4}(?!\w)(?:,\s+\d+º\s*\w?)?(?:,\s+\d{5}\s+[^\W\d_][\w\-]*)?"),
}
_STREET_WORDS = ("street", "st.", "avenue", "ave", "road", "rd.", "lane", "court", "drive", "boulevard", "blvd", "square", "terrace", "crescent", "close", "place", "way", "straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ufer", "rue ", "allée", "impasse", "chemin", "quai", "calle", "c/", "plaza", "avda", "avenida", "paseo")
_DETERMINERS = frozenset("the a an our their this that these those some every my your his her its each any no one".split())
_SUFFIXED = frozenset(("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ufer"))

_NAME_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*")
_INITIAL = re.compile(r"[^\W\d_]\.")
_GAP = re.compile(r"\s+|,\s+")
_TITLE = re.compile(r"(?:%s)\b\.?\s+" % "|".join(_TITLES))
_PARTICLE = re.compile(r"(?:(?:van|von|de|del|della|da|di|bin|al|el|ter|den|der|la)\s+)+")

# Fixed values of public number plans: check letters, and the first digits of payment cards.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_CARD = re.compile(r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")
_CHECKED = re.compile(
    r"(?P<card>\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\w\-])"
    r"|(?P<insee>[1278] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d[\dab] ?\d{3} ?\d{3} ?\d{2})(?![\w\-])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?P<dni>\d{8}-?[a-z])(?![\w\-])"
)
_IBAN = re.compile(r"[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![\w\-])")

_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: " " for c in (11, 12, 13, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
_LATIN_LETTERS = {ord(a): b for a, b in _TO_LATIN.items()}
_LATIN_LANGS = frozenset(("en", "de", "fr", "es"))


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    n = [int(d) for d in reversed(digits)]
    return sum(n[::2]) % 10 == -sum(d * 2 - 9 * (d > 4) for d in n[1::2]) % 10


def iban(number: str) -> bool:
    """Whether the two check digits of an account number hold (mod 97 is 1)."""
    n = number.replace(" ", "")
    return 15 <= len(n) <= 34 and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def checked_id(m: re.Match) -> bool:
    """Whether a number without a cue is that of a card, account or person by its own check."""
    kind = next(k for k in ("card", "insee", "ssn", "dni") if m[k])
    n = re.sub("[ -]", "", m[0])
    if kind == "card":
        return bool(_CARD.match(n)) and luhn(n)
    if kind == "insee":
        return 97 - int(n[:13].replace("a", "0").replace("b", "0")) % 97 == int(n[13:])
    if kind == "ssn":
        return n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"
    return _DNI_LETTERS[int(n[:8]) % 23] == n[8].upper()


class Lexicon:
    """Names known beforehand, parts that several of them share, and a classifier of words.

    The classifier is naive Bayes over the groups of three and four letters of a word, fitted
    on the names against ``words``, or against words that ``count_words`` counted. ``BIAS`` is
    the log odds that a word must give, ``WEIGHT`` that of the frequency in all words, in words.
    """

    BIAS, WEIGHT = 3.0, 20.0

    def __init__(self, names: Iterable[str], words: Iterable[str] = (), counted: tuple[int, dict[str, int], dict[str, int]] | None = None):
        self.names = frozenset(n.lower() for n in names if n)
        other = {w for w in words if w not in self.names} | _FIXED_WORDS
        ends = Counter(n[-4:] for n in self.names if len(n) > 4)
        own = Counter(w[-4:] for w in other if len(w) > 4)
        own.update(counted[2] if counted else {})
        self._is, self._not = Counter(), Counter()
        for w in self.names:
            self._is.update(self._groups(w))
        for w in other:
            self._not.update(self._groups(w))
        self._n_is, self._n_not = len(self.names), len(other)
        #: What a group counts that no name and no other word here has. Counted words hold every
        #: word that is asked for, so the group is met there, and the odds of a group of no name
        #: are the same however often it is.
        self._rest = 0
        if counted:
            self._n_not += counted[0]
            self._not.update(counted[1])
            self._rest = 1
        #: Endings of at least three names that tell by themselves: by the share of the names that
        #: end so against that of the other words, which a larger table leaves as it is.
        self.parts = frozenset(e for e, k in ends.items() if k >= 3 and k * self._n_not > math.exp(self.BIAS) * own[e] * self._n_is)
        self._seen: dict[str, bool] = {}

    @classmethod
    def of(cls, names: Iterable[str], texts: Iterable[str] = ()) -> Lexicon:
        return cls(names, {w for t in texts for w in _NAME_TOKEN.findall(t.lower()) if len(w) > 2})

    @staticmethod
    def _groups(word: str) -> set[str]:
        w = f"^{word}$"
        return {w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)}

    def odds(self, word: str) -> float:
        """Log odds that a word is a name by its letters alone."""
        out = 0.0
        for g in self._groups(word):
            own, other = self._is[g], self._not[g]
            if k := own + other or self._rest:
                # Smoothed towards the frequency of the group in all words.
                prior = self.WEIGHT * k / (self._n_is + self._n_not)
                out += math.log((own + prior) / (self._n_is + self.WEIGHT)) - math.log((k - own + prior) / (self._n_not + self.WEIGHT))
        return out

    def value(self, word: str) -> int:
        """2 for a known name, 1 for a word like one, else 0."""
        if word in self.names:
            return 2
        if (v := self._seen.get(word)) is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            v = self._seen[word] = len(word) >= 5 and word not in _COMMON and word not in _THINGS and word not in _CUE_WORDS and (len(word) >= 6 and word[-4:] in self.parts or self.odds(word) > self.BIAS)
        return int(v)


class Finder:
    """Finds the spans of personal information in texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        anchors: dict[str, list[str]] = {}
        roles = {
            "at": _AT, "id": _ID_CUES, "phone": _PHONE_CUES, "street": _STREET_WORDS, "lives": _ADDRESS_CUES, "called": tuple(_CUE), "title": _TITLES, "known": tuple(lexicon.names), "part": tuple(lexicon.parts),
            "digit": tuple("0123456789"), "spoken": _DIGIT_WORDS,
        }
        for role, words in roles.items():
            for w in words:
                anchors.setdefault(w, []).append(role)
        self.automaton = ahocorasick.Automaton()
        for w, r in anchors.items():
            self.automaton.add_word(w, (w, r))
        self.automaton.make_automaton()

    def spans(self, text: str, lang: str | None = None) -> list[tuple[int, int, str]]:
        """(start, end, kind), in text order and without overlaps."""
        plain, at = self._copy(text, lang)
        low = _lower(plain)
        found: dict[str, list[tuple[int, str]]] = {}
        last_digit = -2
        for end, (word, roles) in self.automaton.iter(low.replace("\n", " ").replace("\t", " ")):
            start = end + 1 - len(word)
            for role in roles:
                if role == "digit":
                    if end != last_digit + 1:  # a run of digits is one anchor
                        found.setdefault(role, []).append((start, word))
                    last_digit = end
                    continue
                if role != "at":
                    if word[-1].isalnum() and end + 1 < len(low) and low[end + 1].isalnum():
                        continue
                    if role != "part" and start and low[start - 1].isalnum() and not (role == "street" and word in _SUFFIXED):
                        continue
                found.setdefault(role, []).append((start, word))
        taken: list[tuple[int, int, str]] = []

        def take(spans: Iterator[tuple[int, int]], kind: str) -> None:
            for a, b in spans:
                if a < b and all(b <= s or a >= e for s, e, _ in taken):
                    taken.append((a, b, kind))

        if "at" in found:
            take(self._emails(low, found["at"]), "email")
        if "digit" in found:
            take(self._ids(plain, low, found.get("id", ()), found["digit"]), "idnum")
        if "street" in found:
            take(self._streets(plain, low, found["street"], found.get("lives", ())), "address")
        take(self._phones(low, found.get("phone", ()), found.get("digit", ()), found.get("spoken", ())), "phone")
        take(self._names(plain, low, found), "name")
        taken.sort()
        if at is None:
            return taken
        return [(at[a], at[b - 1] + 1, k) for a, b, k in taken]

    @staticmethod
    def _copy(text: str, lang: str | None) -> tuple[str, list[int] | None]:
        """The text in plain characters, and the place of each in the text unless they are the same."""
        plain = text.translate(_FOLD) if not text.isascii() else text.replace("\r", " ")
        if not text.isascii() and (lang in _LATIN_LANGS or lang is None):
            plain = plain.translate(_LATIN_LETTERS)
        if "‌" not in plain and "‍" not in plain and not _INVISIBLE.search(plain):
            return plain, None
        at = [i for i, c in enumerate(plain) if c not in "‌‍" and not _INVISIBLE.match(c)]
        return "".join(plain[i] for i in at), at

    @staticmethod
    def _emails(low: str, anchors) -> Iterator[tuple[int, int]]:
        for i, word in anchors:
            spoken = word not in ("@", "%40")
            end = i + len(word)
            if spoken:
                while end < len(low) and low[end].isspace():
                    end += 1
            right = (spoken and _DOMAIN_SPOKEN.match(low, end)) or (word != " at " and _DOMAIN.match(low, end))
            if not right:
                continue
            stop = i
            while spoken and stop and low[stop - 1].isspace():
                stop -= 1
            left = _tail(low, stop, spoken)
            if left < stop and not (word == " at " and low[left:stop] in _NO_MAILBOX):
                yield left, right.end()

    @staticmethod
    def _ids(plain: str, low: str, cues, digits) -> Iterator[tuple[int, int]]:
        for i, word in cues:
            m = _ID_SHAPES.match(low, _ID_LEAD.match(low, i + len(word)).end())
            if m and sum(c.isdigit() for c in m[0]) >= 6:
                yield m.span()
        for i, _ in digits:
            before = low[i - 1] if i else " "
            if before.isalpha():
                if i > 1 and low[i - 2].isalpha() and (i == 2 or not low[i - 3].isalnum()) and (m := _IBAN.match(low, i - 2)) and iban(m[0]):
                    yield m.span()
            elif before not in "_.:/@+-#=" and (m := _CHECKED.match(low, i)) and checked_id(m) and (not m["dni"] or plain[m.end() - 1].isupper()):
                yield m.span()

    @staticmethod
    def _phones(low: str, cues, digits, spoken) -> Iterator[tuple[int, int]]:
        for i, _ in digits:
            if m := _PHONE_SHAPES.match(low, i - 1 if i and low[i - 1] in "+(" else i):
                yield m.span()
        for i, word in cues:
            # Begins within 40 characters of the cue and runs on to its end.
            begin = i + len(word)
            m = next(filter(None, (_PHONE_AFTER_CUE.match(low, p) for p in range(begin, min(begin + 40, len(low))) if low[p] in "+(0123456789")), None)
            if m and not re.search(r"[a-z]{4}", low[begin : m.start()]) and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()
        done = 0
        for i, _ in spoken:
            if i >= done and (m := _SPOKEN_DIGITS.match(low, i)):
                done = m.end()
                yield m.span()

    @staticmethod
    def _streets(plain: str, low: str, anchors, cues) -> Iterator[tuple[int, int]]:
        seen = set()
        for i, _ in anchors:
            for kind, shape in _STREETS.items():
                for m in shape.finditer(low, max(0, i - 60), min(len(low), i + 80)):
                    if m.span() in seen or not m.start() <= i <= m.end():
                        continue
                    seen.add(m.span())
                    cued = any(c < m.start() <= c + len(w) + 12 for c, w in cues)
                    if kind == "en" and not cued:
                        words = plain[m.start() : m.end()].split(",")[0].split()[1:]
                        if not all(w[0].isupper() and not w.isupper() for w in words) or words[0].lower() in _DETERMINERS:
                            continue
                    yield m.span()

    def _names(self, plain: str, low: str, found: dict[str, list[tuple[int, str]]]) -> Iterator[tuple[int, int]]:
        for i, word in found.get("called", ()):
            begin = i + len(word)
            while begin < len(low) and low[begin] in " :,\n\t":
                begin += 1
            if span := self._person(plain, low, begin, _CUE[word]):
                yield span
        for i, _ in found.get("title", ()):
            if span := self._person(plain, low, i, 0):
                yield span
        for i, _ in sorted((*found.get("known", ()), *found.get("part", ()))):
            while i and (low[i - 1].isalpha() or low[i - 1] in "'’-"):
                i -= 1
            m = _NAME_TOKEN.match(low, i)
            if not m or (i and low[i - 1] in "@._+-/") or (m.end() < len(low) and (low[m.end()] in "@_+" or low[m.end()] in "-." and low[m.end() + 1 : m.end() + 2].isalnum())):
                continue
            # The name may be the first word of a person or the second.
            before = re.compile(r"([^\W\d_][^\W\d_'’\-]*)(?:,?\s+|\s+[^\W\d_]\.\s+)$").search(low, max(0, i - 40), i)
            if before and (span := self._person(plain, low, before.start(1), 0)) and span[1] > i:
                yield span
            elif span := self._person(plain, low, i, 0):
                yield span

    def _person(self, plain: str, low: str, begin: int, cue: int) -> tuple[int, int] | None:
        """The name that begins here, with its title, if its look and the cue's strength suffice."""
        start, titled = begin, False
        while t := _TITLE.match(low, begin):
            if (w := t[0].split()[0].rstrip(".")) in _ALSO_WORDS:
                own = plain[begin].isupper() and (len(w) == 1 or plain[begin + 1].islower()) or w == "don" and "." not in t[0] and plain[t.end() + 1 : t.end() + 2].islower()
                if not own or not plain[t.end() : t.end() + 1].isupper():
                    break
            begin, titled = t.end(), True
        tokens: list[tuple[int, int]] = []
        comma, p = False, begin
        for _ in range(5):
            if m := _INITIAL.match(low, p):
                p = m.end()
            elif tokens and (m := _PARTICLE.match(low, p)) and plain[tokens[0][0]].isupper() and plain[m.end() : m.end() + 1].isupper():
                p = m.end()
                continue
            elif (m := _NAME_TOKEN.match(low, p)) and m[0] not in _COMMON and m[0] not in _THINGS and not (tokens and m[0] in _OTHER_CUES):
                tokens.append(m.span())
                p = m.end()
            else:
                break
            gap = _GAP.match(low, p)
            if not gap or (gap[0][0] == "," and (len(tokens) != 1 or comma)) or len(tokens) == 3:
                break
            comma |= gap[0][0] == ","
            p = gap.end()
        if not tokens:
            return None
        value = [self.lexicon.value(low[a:b]) for a, b in tokens]
        # A capital says something where not all letters are capitals; a family name may be all of them.
        big = [plain[a].isupper() and (k > 0 or plain[a + 1 : b].islower() or b - a == 1) for k, (a, b) in enumerate(tokens)]
        last = -1
        if len(tokens) > 1 and self._two(plain, low, tokens, value, big, cue, titled, comma):
            last = 2 if len(tokens) > 2 and not comma and value[2] == 2 and big[0] == big[2] else 1
        elif titled:
            last = 0 if big[0] or value[0] or cue else -1
        elif value[0] == 2 and cue or value[0] and cue > 2 or big[0] and cue > 3:
            last = 0
        if last < 0 or _NOT_A_PERSON.match(low, tokens[last][1]):
            return None
        return start if titled else tokens[0][0], tokens[last][1]

    @staticmethod
    def _two(plain: str, low: str, tokens, value: list[int], big: list[bool], cue: int, titled: bool, comma: bool) -> bool:
        """Whether the first two words are those of one person."""
        both, known = big[0] and big[1], value[0] + value[1]
        if big[0] > big[1]:
            return False
        if titled:
            return bool(value[1]) and big[0] == big[1]
        if comma and not known and cue < 4:
            return False
        if cue == 4:
            return True
        if cue == 3:
            return both or known > 0 or min(b - a for a, b in tokens[:2]) >= 5
        if cue:
            return both and (cue == 2 or known > 0) or known > 1 or bool(_SPEAKS.match(low, tokens[1][1]))
        if value[0] and value[1]:
            return True
        # A known name beside an unknown word with a capital: not where any word has one.
        first = tokens[0][0]
        opens = first == 0 or plain[first - 1] in "\n\t" or bool(re.search(r"[.!?:|*\-]\s*$", plain[max(0, first - 3) : first]))
        return both and not comma and (value[0] == 2 or value[1] == 2 and not opens)


def _lower(plain: str) -> str:
    """In lower case, of the same length."""
    low = plain.lower()
    return low if len(low) == len(plain) else "".join(x if len(x := c.lower()) == 1 else c for c in plain)


def _tail(low: str, stop: int, spoken: bool) -> int:
    """Where the local part that ends at ``stop`` begins; ``stop`` if there is none."""
    i = stop
    while i and (low[i - 1].isascii() and (low[i - 1].isalnum() or low[i - 1] in "._%+-")):
        i -= 1
    while i < stop and not low[i].isalnum():
        i += 1
    if i == stop or not _LOCAL.match(low[i:stop]):
        return stop
    if spoken:
        joint = re.compile(r"([a-z0-9][a-z0-9_%+\-.]*)(?:\s+(?:dot|underscore|dash|hyphen|plus)\s+|\s*[\[({](?:dot|underscore)[\])}]\s*)$")
        while m := joint.search(low, max(0, i - 80), i):
            i = m.start(1)
    return i


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


_finders: dict[str, Finder] = {}


def count_words(rows: DataFrame, names: Iterable[str]) -> tuple[int, dict[str, int], dict[str, int]]:
    """Over the different words of all rows (text, lang), the names and the fixed words aside: their number, how many hold each letter group of a name, and how many end as a name does.

    Words are made as the finder makes them. A word is shuffled once a task, and a table of the
    size of the names' groups comes back; groups of no name need no count (see ``Lexicon``).
    """
    names = frozenset(n.lower() for n in names if n)
    sent = rows.sparkSession.sparkContext.broadcast((names | _FIXED_WORDS, {g for n in names for g in Lexicon._groups(n)}, {n[-4:] for n in names if len(n) > 4}))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out, met, held = sent.value[0], set(), 0
        for b in batches:
            new = []
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in set(_NAME_TOKEN.findall(_lower(Finder._copy(t, g)[0]))) - met if t else ():
                    if len(w) > 2 and w not in left_out:
                        new.append(w)
                        held += len(w)
                        met.add(w)
                if len(met) > MET_WORDS or held > MET_CHARS:
                    met, held = set(), 0
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["w"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, groups, ends = sent.value
        n, held, ended = 0, Counter(), Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                n += 1
                held.update(groups & Lexicon._groups(w))
                if len(w) > 4 and w[-4:] in ends:
                    ended[w[-4:]] += 1
        parts = [("n", "", n), *(("group", g, k) for g, k in held.items()), *(("end", g, k) for g, k in ended.items())]
        yield pa.RecordBatch.from_pylist([dict(zip(("what", "g", "k"), p)) for p in parts], pa.schema([("what", pa.string()), ("g", pa.string()), ("k", pa.int64())]))

    different = rows.mapInArrow(words, "w string").distinct()
    out = different.mapInArrow(count, "what string, g string, k bigint").groupBy("what", "g").agg(F.sum("k").alias("k")).collect()
    of = lambda what: {r["g"]: r["k"] for r in out if r["what"] == what}
    return of("n").get("", 0), of("group"), of("end")


def find_personal(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, text, kinds, n_found): the redacted text and the sorted kinds found, of every row.

    Null texts stay null, empty texts empty; repeated rows stay. The lexicon (column ``name``)
    is a fixed table; its size is checked before it is sent to the tasks. The classifier of
    names is fitted on it and on the different words of all rows, which are all that is shuffled.
    """
    names = [r["name"] for r in lexicon.select("name").filter("name is not null").limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError("the name lexicon is too large to send to every task")
    counted = count_words(df.select(F.col(text).cast("string"), F.col(lang).cast("string")), names)
    sent = df.sparkSession.sparkContext.broadcast((names, counted))
    kind, mark = df.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (finder := _finders.get(mark)) is None:
            _finders.clear()
            finder = _finders[mark] = Finder(Lexicon(sent.value[0], counted=sent.value[1]))
        for b in batches:
            texts, kinds, n = [], [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = finder.spans(t, g) if t else []
                texts.append(redact(t, spans) if spans else t)
                kinds.append(sorted({k for _, _, k in spans}))
                n.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(n, pa.int32())], names=["key", "text", "kinds", "n_found"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, f"key {kind}, text string, kinds array<string>, n_found int").withColumnRenamed("key", key)
