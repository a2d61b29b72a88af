"""Personal information in running text: detection, typed placeholders and surrogates.

Mentions of email addresses, phone numbers, identity numbers, street addresses
and personal names are found per text. Every distinct entity gets a keyed
surrogate of its own kind: numbers are permuted within their format, names keep
gender, script and letter case, initials follow the names they begin, addresses keep
their layout. Surrogates are checked, as they will stand in the text, against each
other and against the real entities across the whole corpus; colliding ones are
drawn again, so different entities stay different and one entity, however it is
written, gets one surrogate. ``redacted`` holds the
text with typed placeholders, ``surrogate`` the same text with surrogates.

Defined cases: a null text gives null texts and no mentions; an empty text
stays empty; overlapping mentions are settled by type (email, address, identity
number, phone, name), then by position; repeated rows are rewritten each; texts
are processed whole, whatever their length; an empty table gives no rows;
further columns, also of clashing names, do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.runtime import cut, join_hot

TYPES = ("EMAIL", "ADDRESS", "ID_NUMBER", "PHONE", "NAME")

# Words that introduce a personal name, and titles before one.
CUES_BEFORE = (
    "my name is", "name:", "i am called", "signed by", "signed,", "regards,", "sincerely,", "yours,", "cheers,", "cc:", "ask for", "asked for",
    "spoke with", "spoke to", "talk to", "talked to", "written by", "reported by", "reviewed by", "found by", "blame", "thanks to", "contact",
)
CUES_AFTER = (
    "reviewed it", "who broke", "wrote it", "wrote this", "reported it", "fixed it", "told me", "about it", "for that", "it builds again",
)
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Sra", "Señora", "Signora", "Lady")
TITLES_MALE = ("Mr", "Monsieur", "Herr", "Sr", "Señor", "Signor", "Sir", "Lord")
TITLES_ANY = ("Dr", "Prof", "Professor", "Rev", "Pr", "Ing")
STREETS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "court", "ct", "drive", "dr", "way", "place", "pl", "row", "terrace",
    "square", "sq", "boulevard", "blvd", "crescent", "gardens", "grove", "hill", "walk", "mews", "quay", "parkway", "highway", "rise", "view", "green", "yard",
)
DIGIT_WORDS = {"zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# Invisible characters and other blanks may stand inside a mention.
_B = r"[ \t    ]"
_H = r"[-‐‑–]"
_L = r"[^\W\d_]"
_UP = r"(?:(?![a-zß-öø-ÿ])[^\W\d_])"

_AT = rf"(?:{_B}?[@＠]{_B}?|{_B}*[\[({{<]{_B}*(?i:at){_B}*[\])}}>]{_B}*|{_B}+AT{_B}+|{_B}+at{_B}+(?=[\w-]+(?:{_B}+dot{_B}+[\w-]+)+))"
_DOT = rf"(?:\.|{_B}*[\[({{<]{_B}*(?i:dot){_B}*[\])}}>]{_B}*|{_B}+(?:DOT|dot){_B}+)"
EMAIL = re.compile(rf"(?:mailto:)?(?<![\w.+-])[\w](?:[\w.+'%-]*[\w])?{_AT}[\w](?:[\w-]*[\w])?(?:{_DOT}[\w](?:[\w-]*[\w])?)*{_DOT}[^\W\d_]{{2,}}(?![\w@])")

#: Necessary for an address that EMAIL accepts.
_AT_GATE = re.compile(rf"[@＠]|[\[({{<]{_B}*(?i:at){_B}*[\])}}>]|{_B}AT{_B}|{_B}at{_B}+[\w-]+{_B}+dot{_B}")

_WORD_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
PHONE = re.compile(
    rf"""(?<![\w.])(?:
    \+\d{{1,3}}(?:[ . ‑/-]?\(?\d+\)?){{1,7}}
    | (?:1[ .-])?\(\d{{2,5}}\)[  .-]?\d{{3,5}}(?:[  .‑-]\d{{2,5}})+
    | \d{{3}}(?P<s>[ . ‑-])\d{{3}}[ . ‑-]\d{{4}}
    | 0\d(?:[ . -]\d\d){{4}}
    | 0\d{{2,4}}[  /-]\d{{3,4}}[  -]\d{{3,4}}
    | 0\d{{3,4}}[  /-]\d{{5,7}}
    | 0\d{{9,10}}
    )(?:{_B}*(?:ext|extension|x)\.?{_B}*\d{{1,5}})?(?![\w]|[.,-]\d)""",
    re.X,
)
PHONE_WORDS = re.compile(rf"\b{_WORD_DIGIT}(?:[ ,.-]+{_WORD_DIGIT}){{6,}}\b", re.I)
PHONE_CUE = re.compile(r"\b(?:tel|phone|call|fax|text|signal|mobile|ring)\b[^\d\n]{0,12}(\d{9,12})(?!\d)", re.I)

ID_CUE = re.compile(
    rf"""\b(?:ssn|social{_B}security(?:{_B}(?:number|no\.?))?|ni{_B}number|national{_B}insurance(?:{_B}number)?|nino|passport|steuer-?id|tax{_B}id|national{_B}id
    |identity{_B}card|id{_B}card|identity{_B}number|driver'?s?{_B}licen[cs]e|driving{_B}licen[cs]e|personalausweis|dni|nie)
    (?:{_B}?(?:no|number|nr|num)\b\.?)?{_B}*[:\#=]?{_B}*(?:is{_B})?
    (?P<id>[A-ZÀ-Þ0-9](?:[^\W_]|[ . /-](?=[^\W_]*\d)){{4,24}}(?:{_B}[A-Z]\b)?)""",
    re.X | re.I,
)
ID_BARE = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z][A-Z] ?\d\d ?\d\d ?\d\d ?[A-D])(?![\w-])")

_TOWN = rf"{_L}+(?:-{_L}+)*"
_POST = rf"(?:[A-Z]{{1,2}}\d[A-Z\d]?{_B}\d[A-Z]{{2}}|\d{{5}}(?:-\d{{4}})?)"
_TYPE = "(?:" + "|".join(STREETS) + ")"
_NO = r"\d{1,5}[a-z]?"
_TAIL = rf"(?:,?[ \n]{_B}*(?:apt|apartment|unit|suite|flat|no)\.?{_B}*\w{{1,5}})?"
ADDRESS = re.compile(
    rf"""(?<![\w$\#.])(?:
    p\.?{_B}?o\.?{_B}box{_B}\d{{1,6}}(?:,\s{_TOWN})?(?:{_B}{_POST})?
    | (?:(?:flat|apartment|apt|unit|suite)\.?{_B}\w{{1,4}},\s)?{_NO}{_B}(?!(?:of|in|at|and|per|or)\b)(?:{_L}[\w'’-]*{_B}){{1,3}}?{_TYPE}\b\.?{_TAIL}(?:,?\s{_TOWN})?(?:,?\s{_POST})?
    | {_NO}(?:{_B}(?:bis|ter))?,?{_B}(?:rue|avenue|boulevard|place|chemin|impasse|quai){_B}(?:(?:du|de{_B}la|de|des|d')[ ']?)?{_L}[\w'’-]*(?:,?\s\d{{5}})?(?:,?\s{_TOWN})?
    | (?:calle|avenida|plaza|paseo|via|viale|piazza){_B}(?:de{_B}(?:la{_B})?)?{_L}[\w'’-]*,?{_B}{_NO}(?:,\s\d{{5}}{_B}{_TOWN})?
    | {_L}+(?:gasse|straße|strasse|str\.|weg|platz|allee|ufer|ring|damm){_B}{_NO}(?:,\s\d{{4,5}}{_B}{_TOWN})
    )(?!\w)""",
    re.X | re.I,
)
#: A street name with a number says little without a town, a flat, a postcode or a capital.
_ADDRESS_SURE = re.compile(rf",|\n|box|{_POST}|\b(?:rue|calle|avenida|plaza)\b|gasse|straße|(?<!\w)\d+\w? {_UP}")

_TITLE = "(?:" + "|".join((*TITLES_FEMALE, *TITLES_MALE, *TITLES_ANY)) + r")\b\.?"
_ANY_WORD = rf"{_L}(?:{_L}|['’](?={_L})|-(?={_L}))+"


_ITEM = re.compile(rf"(?:({_TITLE})(?={_B}))|({_ANY_WORD}|{_L}\.|{_L}\b)|,")
_CUE_BEFORE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, CUES_BEFORE)).replace(r"\ ", r"\s") + r")\s*[\"'(]?", re.I)
_CUE_AFTER = re.compile(r"[\"')]?,?\s*(?:" + "|".join(map(re.escape, CUES_AFTER)).replace(r"\ ", r"\s") + r")\b", re.I)
_PRONOUNS = frozenset(
    """a an the i we you he she it they me us him her them my our your his its their this that these those some any no one every each all
    somebody someone nobody everybody anyone who what which not never just only also still again and or but so if in on at by for from to of with as is was were be been
    me myself here there now then soon way kind fun easy hard nice good great ours mine""".split()
)
_TITLE_WORDS = frozenset(x.lower() for x in (*TITLES_FEMALE, *TITLES_MALE, *TITLES_ANY))
_TITLE_HINT = re.compile(r"\b" + _TITLE)


def fold(text: str) -> str:
    """Lower case without accents or invisible characters, for comparing names."""
    plain = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o"))
    return "".join(c for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


class Detector:
    """Finds mentions. ``given`` and ``family`` are known name parts; names not listed are known by their context."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = {fold(x) for x in given}, {fold(x) for x in family}
        self.listed = self.given | self.family

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type), in order and without overlaps."""
        found: list[tuple[int, int, str]] = []  # in order
        low = text.lower()

        def add(start: int, end: int, kind: str) -> None:
            at = bisect_left(found, (start, end, kind))
            if (not at or found[at - 1][1] <= start) and (at == len(found) or end <= found[at][0]):
                found.insert(at, (start, end, kind))

        if "@" in text or "＠" in text or "at" in low and _AT_GATE.search(text):
            for m in EMAIL.finditer(text):
                add(m.start(), m.end(), "EMAIL")
        words = set(_SPLIT.split(low))
        if _DIGIT.search(low):
            if not _ADDRESS_WORDS.isdisjoint(words) or any(x in low for x in _ADDRESS_ENDS):
                for m in ADDRESS.finditer(text):
                    if _ADDRESS_SURE.search(m.group()):
                        add(m.start(), m.end(), "ADDRESS")
            digits = len(_DIGIT.findall(low))
            if digits >= 5 and any(x in low for x in _ID_WORDS):
                for m in ID_CUE.finditer(text):
                    value = m.group("id")
                    if sum(c.isdigit() for c in value) >= 5:
                        add(m.start("id"), m.start("id") + len(value.rstrip()), "ID_NUMBER")
            if digits >= 6:
                for m in ID_BARE.finditer(text):
                    add(m.start(), m.end(), "ID_NUMBER")
            if digits >= 7:
                for m in PHONE.finditer(text):
                    if 7 <= sum(c.isdigit() for c in m.group()) <= 17:
                        add(m.start(), m.end(), "PHONE")
                for m in PHONE_CUE.finditer(text):
                    add(m.start(1), m.end(1), "PHONE")
        if any(x in low for x in DIGIT_WORDS):
            for m in PHONE_WORDS.finditer(text):
                add(m.start(), m.end(), "PHONE")
        for a, b in self._names(text, low, words):
            add(a, b, "NAME")
        return found

    def _names(self, text: str, low: str, words: set[str]) -> Iterator[tuple[int, int]]:
        flat = re.sub(r"\s", " ", low)
        if any(x in flat for x in CUES_BEFORE):
            for m in _CUE_BEFORE.finditer(text):
                if span := self._at(text, m.end(), True, m.group().rstrip().endswith((",", ":"))):
                    yield span
        if any(x in flat for x in CUES_AFTER):
            for m in _CUE_AFTER.finditer(text):
                if span := self._before(text, m.start()):
                    yield span
        if not _TITLE_WORDS.isdisjoint(words) or not low.isascii():
            for m in _TITLE_HINT.finditer(text):
                if span := self._at(text, m.start(), True):
                    yield span
        if not self._may_list(low, words):
            return
        for m in _RUN.finditer(text):
            if fold(m.group()) in self.listed and (span := self._around(text, m)):
                yield span

    def _may_list(self, low: str, words: set[str]) -> bool:
        if low.isascii():
            return not self.listed.isdisjoint(words) or "-" in low and any(x in low for x in self.listed if "-" in x)
        return any(fold(w) in self.listed for w in re.findall(_ANY_WORD, low))

    def _items(self, text: str, at: int) -> list[tuple[str, int, int]]:
        """The words, initials and commas that stand directly behind each other from ``at``: at most a title and five items."""
        out: list[tuple[str, int, int]] = []
        while len(out) < 6 and (m := _ITEM.match(text, at)):
            out.append((m.group(), at, m.end()))
            at = m.end()
            if (gap := _GAP.match(text, at)) and gap.end() > at:
                at = gap.end()
            elif text[at : at + 1] != "," and out[-1][0] != "," and not out[-1][0].endswith("."):
                break
        return out

    def _name_like(self, word: str, upper: bool, lower: bool) -> bool:
        bare = word.rstrip(".")
        if bare.lower() in _PRONOUNS and not (word.endswith(".") and len(bare) == 1):
            return False
        if word.endswith(".") and len(bare) == 1:
            return bare.isupper() or lower
        return bare[0].isupper() or lower

    def _at(self, text: str, at: int, cued: bool, signed: bool = False) -> tuple[int, int] | None:
        """The name that begins at ``at`` after a cue or with a title; after a signature nothing but the name precedes the next sentence."""
        items = self._items(text, at)
        title = False
        if items and items[0][0].rstrip(".").lower() in _TITLE_WORDS and items[0][0][0].isupper():
            title, items = True, items[1:]
        if not items:
            return None
        words = [w for w, _, _ in items]
        all_lower = words[0][0].islower()
        end = None
        if all_lower:
            # a name without capitals needs a listed part, or a cue and a closed end
            if len(words) >= 2 and words[0].isalpha() and "," not in words[:2] and self._lower_pair(text, items, signed):
                end = items[1][2]
            elif len(words) >= 3 and words[1] == "," and fold(words[0]) in self.family and fold(words[2]) in self.given:
                end = items[2][2]
        else:
            if not self._name_like(words[0], True, False):
                return None
            loud = words[0].isupper() and len(words[0]) > 2
            n = 1
            if len(words) >= 3 and words[1] == "," and len(words[0]) > 2 and self._name_like(words[2], True, False) and words[2] != ",":
                if cued or fold(words[2].rstrip(".")) in self.given or fold(words[0]) in self.family or self._closed(text, items[2][2]):
                    end = items[2][2]
                    if len(words) > 3 and len(words[3].rstrip(".")) == 1 and words[3][0].isupper() and words[3].endswith("."):
                        end = items[3][2]
            if end is None:
                while n < len(words) and words[n] != "," and self._name_like(words[n], True, False) and (not loud or words[n].isupper()):
                    if len(words[n].rstrip(".")) > 1 and len(words[n - 1].rstrip(".")) > 1 and n >= 2 - (len(words[0].rstrip(".")) == 1):
                        break  # a given and a family name are complete
                    if title and n == 1 and fold(words[0].rstrip(".")) in self.family:
                        break  # so is a title with a family name
                    n += 1
                last = n - 1
                if len(words[last].rstrip(".")) < 2:
                    return None
                if n == 1 and not title and fold(words[0]) not in self.family:
                    return None  # one word alone is no family name, unless listed or after a title
                if n >= 2 and fold(words[last]) in self.given and fold(words[0]) not in self.listed and not title and not self._closed(text, items[last][2]):
                    return None
                end = items[last][2] - (words[last].endswith("."))
        if end is None:
            return None
        return (at, end) if not self._in_token(text, at, end) else None

    def _closed(self, text: str, end: int) -> bool:
        return not text[end : end + 1] or bool(_CLOSED.match(text, end)) or bool(_CUE_AFTER.match(text, end))

    def _lower_pair(self, text: str, items: list[tuple[str, int, int]], signed: bool) -> bool:
        a, b = fold(items[0][0]), fold(items[1][0].rstrip("."))
        if a in _PRONOUNS or b in _PRONOUNS or not items[1][0][0].islower():
            return False
        return a in self.given or b in self.family or a not in _COMMON and b not in _COMMON and len(a) > 2 and len(b) > 4 and (self._closed(text, items[1][2] - items[1][0].endswith(".")) or signed and text[items[1][2] + 1 : items[1][2] + 2].isupper())

    def _in_token(self, text: str, a: int, b: int) -> bool:
        return bool(text[a - 1 : a] and text[a - 1] in "@._+/\\-" and a) or text[b : b + 1] in {"@", "_", "+"} and b < len(text)

    def _before(self, text: str, end: int) -> tuple[int, int] | None:
        """The name that ends right before a cue."""
        start = max(0, end - 60)
        best = None
        for m in _RUN_START.finditer(text, start, end):
            span = self._at(text, m.start(), True)
            if span and span[1] == end and (best is None or m.start() < best[0]):
                best = span
        return best

    def _around(self, text: str, m: re.Match) -> tuple[int, int] | None:
        """A listed part with what makes it a full name around it."""
        for back in (2, 1, 0):
            at, ok = m.start(), True
            for _ in range(back):
                prior = _PRIOR.search(text, max(0, at - 40), at)
                if not prior:
                    ok = False
                    break
                at = prior.start(1)
            if ok and (span := self._at(text, at, False)) and span[1] >= m.end():
                inner = [fold(w.rstrip(".")) for w in re.findall(rf"{_ANY_WORD}", text[span[0] : span[1]])]
                if any(w in self.family for w in inner) or len(inner) >= 2 and (inner[0] in self.given or inner[-1] in self.given and "," in text[span[0] : span[1]]):
                    return span
        return None


_DIGIT = re.compile(r"\d")
_ADDRESS_WORDS = frozenset((*STREETS, "box", "rue", "quai", "impasse", "chemin", "calle", "avenida", "plaza", "paseo", "via", "viale", "piazza"))
_ADDRESS_ENDS = ("gasse ", "straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "ufer ", "ring ", "damm ")
_ID_WORDS = ("ssn", "social", "ni ", "insurance", "nino", "passport", "steuer", "tax", "national", "identity", "card", "licen", "ausweis", "dni", "nie")
_SPLIT = re.compile(r"[^a-z]+")
_GAP = re.compile(rf"{_B}+")
_RUN = re.compile(_ANY_WORD)
_RUN_START = re.compile(rf"(?<![\w@.+/\\-]){_L}")
_PRIOR = re.compile(rf"(?<![\w@.+/\\-])({_ANY_WORD},|{_ANY_WORD}|{_L}\.){_B}+$")
_CLOSED = re.compile(r"\s*(?:$|[.;:!?)\n(]|,(?!\s?\w+\s\w)|\s(?:and|from|at|in|with|who|or|via)\b)")
_COMMON = frozenset(
    """maintainer author team vendor committee colleague intern reviewer reviewers owner owners mailing list people else fact time first last more less very really worth about
    thing things part parts code work works right wrong true false clear likely sure plain simple quick slow real same other others new old big small long short next previous""".split()
)


def _scan(given: list[str], family: list[str], everything: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(set(given), set(family))
        for batch in batches:
            rows = []
            for table, row, text in zip(batch["src_table"], batch["row_id"], batch["text"]):
                spans = detector.find(text) if text else []
                if spans or everything:
                    rows.append((table, row, text, [{"start": a, "stop": b, "pii_type": t, "parts": parts(text[a:b], t)} for a, b, t in spans]))
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "text", "mentions"])

    return run


# --- entities and surrogates ---------------------------------------------------

_MENTIONS = "array<struct<start:int,stop:int,pii_type:string,parts:array<struct<kind:string,entity:string,hint:int>>>>"

# Common given names whose gender their ending does not tell.
_MEN = frozenset("luca andrea nikita joshua elia mike luke george pierre andre philippe guillaume antoine jerome etienne bruce wayne dale kyle steve dave joe pete jose jorge felipe enrique vicente uwe malte arne".split())
_WOMEN = frozenset("ingrid astrid karin carmen isabel raquel beatriz ines margot ruth esther kathryn susan helen joan karen megan erin lauren mary emily lucy nancy betty dorothy sarah elizabeth judith gertrud ingeborg manon marion".split())


def is_woman(given: str) -> bool:
    return given in _WOMEN or given not in _MEN and given[-1:] in {"a", "e", "а", "я", "α", "η"}


def parts(mention: str, kind: str) -> list[dict]:
    """The entities of a mention: given and family names count by themselves, so that all forms of a name corefer.

    ``hint`` is what a title says of a given name: 1 for a woman, -1 for a man.
    """
    if kind == "NAME":
        words = [w for w in re.findall(rf"{_ANY_WORD}|{_L}\.", mention)]
        titled = [w.rstrip(".").lower() for w in words if w.rstrip(".").lower() in _TITLE_WORDS]
        full = [w for w in words if not w.endswith(".") and w.lower() not in _TITLE_WORDS]
        if not full:
            return []
        last = 0 if "," in mention else len(full) - 1
        hint = any(w in _OF_WOMEN for w in titled) - any(w in _OF_MEN for w in titled)
        return [{"kind": "family" if k == last else "given", "entity": fold(w), "hint": 0 if k == last else hint} for k, w in enumerate(full)]
    if kind == "EMAIL":
        plain = re.sub(_DOT, ".", re.sub(_AT, "@", mention, count=1)).lower()
        entity = ("email", plain.removeprefix("mailto:"))
    elif kind == "PHONE":
        digits = "".join(DIGIT_WORDS.get(w, "") for w in re.findall("[a-z]+", mention.lower())) or re.sub(r"\D", "", unicodedata.normalize("NFKC", mention))
        entity = ("phone", digits)
    elif kind == "ID_NUMBER":
        entity = ("id", re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", mention)).upper())
    else:
        entity = ("address", re.sub(r"[^\w]+", " ", fold(mention)).strip())
    return [{"kind": entity[0], "entity": entity[1], "hint": 0}]


_OF_WOMEN, _OF_MEN = ({x.lower() for x in titles} for titles in (TITLES_FEMALE, TITLES_MALE))


def _digest(key: bytes, *what: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")


_ONSETS = ("b", "br", "c", "d", "dr", "f", "g", "gl", "h", "j", "k", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v", "w", "z")
_VOWELS, _CODAS = ("a", "e", "i", "o", "u"), ("", "l", "n", "r", "s", "m", "")
_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of the scripts in which surrogates are pronounceable, and how Latin syllables are written in them.
_ALPHABETS = {"latin": _LATIN, "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_WRITTEN = {"cyrillic": str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувухиз"), "greek": str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβκδεφγηιζκλμνοπκρστυβωξυζ")}


def _script(text: str) -> str:
    for c in text:
        for script, letters in _ALPHABETS.items():
            if c in letters or script == "cyrillic" and "\u0400" <= c <= "\u04ff" or script == "greek" and "\u0370" <= c <= "\u03ff":
                return script
        if c.isalpha() and not "\u00c0" <= c <= "\u024f":
            return ""
    return "latin"


@functools.lru_cache(4096)
def letter(key: bytes, c: str) -> str:
    """The letter that stands for an initial: a keyed permutation of the alphabet, which also begins the surrogates of given names."""
    low = fold(c)[:1] or c
    alphabet = _ALPHABETS.get(_script(low), "")
    if low not in alphabet or not alphabet:
        return _same_block(key, "initial", low, 0)
    mixed = sorted(alphabet, key=lambda x: _digest(key, "letter", x))
    made = mixed[(mixed.index(low) + 1) % len(mixed)]  # one ring, so that no letter stands for itself
    return made.upper() if c.isupper() else made


def _same_block(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """Letters of other scripts give way to letters of their own block."""
    out = []
    for i, c in enumerate(unicodedata.normalize("NFC", entity)):
        if c.isalpha():
            first, n = (0xAC00, 11172) if "\uac00" <= c <= "\ud7a3" else (0x4E00, 20902) if "\u4e00" <= c <= "\u9fff" else (ord(c) & ~0x3F, 64)
            some = range(first, first + n) if n > 64 else [x for x in range(first, first + n) if unicodedata.category(chr(x)) == unicodedata.category(c)]
            c = chr(some[_digest(key, kind, entity, attempt, i) % len(some)])
        out.append(c)
    return "".join(out)


def _syllables(number: int, count: int, end: str = "") -> str:
    out = ""
    for i in range(count):
        number, a = divmod(number, len(_ONSETS))
        number, b = divmod(number, len(_VOWELS))
        number, c = divmod(number, len(_CODAS))
        out += _ONSETS[a] + _VOWELS[b] + ("" if end and i == count - 1 else _CODAS[c])
    return out + end


def permuted(key: bytes, text: str, tweak: object = "") -> str:
    """A keyed permutation of all texts with digits, capitals and small letters in the same places: different texts never meet."""
    radix = [10 if c in "0123456789" else 26 for c in text if c.isascii() and c.isalnum()]
    digit = [ord(c) - (48 if c in "0123456789" else 65 if c.isupper() else 97) for c in text if c.isascii() and c.isalnum()]
    half = len(radix) // 2
    shape = "".join("0" if c in "0123456789" else "A" if c.isupper() else "a" if c.isascii() and c.isalpha() else c for c in text)
    sides, sizes = [0, 0], [1, 1]
    for k, (d, r) in enumerate(zip(digit, radix)):
        sides[k >= half], sizes[k >= half] = sides[k >= half] * r + d, sizes[k >= half] * r
    for r in range(10):  # each step adds to one half what the other one gives, and so can be undone
        sides[r % 2] = (sides[r % 2] + _digest(key, "permuted", tweak, shape, r, sides[1 - r % 2])) % sizes[r % 2]
    made = [0] * len(radix)
    for k in range(len(radix) - 1, -1, -1):
        sides[k >= half], made[k] = divmod(sides[k >= half], radix[k])
    values = iter(made)
    return "".join(chr(ord(s) + next(values)) if c.isascii() and c.isalnum() else c for c, s in zip(text, shape))


_STREET_WORDS = frozenset((*STREETS, "flat", "apt", "apartment", "unit", "suite", "no", "box", "rue", "quai", "chemin", "impasse", "calle", "avenida", "plaza", "paseo", "via", "viale", "piazza", "bis", "ter", "du", "de", "des", "la", "d", "p", "o", "po"))


def draw(key: bytes, kind: str, entity: str, attempt: int, woman: bool | None = None) -> str:
    """The keyed surrogate of an entity, as it will stand in the text but for its letter case and separators."""
    n = _digest(key, kind, entity, attempt)
    if kind in {"family", "given"}:
        script = _script(entity)
        if not script:
            return _same_block(key, kind, entity, attempt)
        if kind == "family":
            made = _syllables(n, 3 + attempt // 4, ("mont", "feld", "ley", "ard", "sen", "ova", "ier")[n % 7])
            return made.translate(_WRITTEN.get(script, {}))
        female = is_woman(entity) if woman is None else woman
        first = letter(key, entity[0])
        made = _syllables(n, 2 + attempt // 4, ("a", "ia", "ine")[n % 3] if female else ("o", "us", "ard")[n % 3])
        bare = made.lstrip("bcdfghjklmnpqrstvwz") if first.translate(_WRITTEN.get(script, {})) not in "aeiouаеиоуαειου" else made
        return first + bare.translate(_WRITTEN.get(script, {}))
    if kind == "email":
        return f"{_syllables(n, 3 + attempt // 4)}{n % 1000:03d}@{_syllables(n >> 64, 2)}.example"
    if kind == "address":
        words = entity.split(" ")
        mixed = [w.isascii() and any(c.isdigit() for c in w) for w in words]
        same = [m or w in _STREET_WORDS for w, m in zip(words, mixed)]
        ends = [next((e.strip() for e in _ADDRESS_ENDS if w.endswith(e.strip(" .")) and len(w) > len(e)), "") for w in words]
        made = [w if s else _syllables(_digest(key, "place", w, attempt), 2 + (len(w) > 7)) + e for w, s, e in zip(words, same, ends)]
        # numbers and codes change together, by a permutation of their own for every street
        codes = iter(permuted(key, " ".join(w for w, m in zip(words, mixed) if m), ("address", attempt, *["#" if m else w for w, m in zip(words, mixed)])).split(" "))
        return " ".join(next(codes) if m else w for w, m in zip(made, mixed))
    return permuted(key, entity, (kind, attempt))


def render(mention: str, kind: str, found: list[tuple[str, str, str]], key: bytes = b"") -> str:
    """The surrogate in the mention's own layout: letter case, order, separators, initials and spelled-out digits."""

    def cased(new: str, old: str) -> str:
        return new.upper() if old.isupper() and len(old) > 1 else new.title() if old[:1].isupper() else new

    if kind == "NAME":
        known = {entity: made for _, entity, made in found}

        def named(m: re.Match) -> str:
            word = m.group()
            if m.group(1):
                return letter(key, word[0]) + word[1:]
            return cased(known[fold(word)], word) if fold(word) in known and word.lower() not in _TITLE_WORDS else word

        return re.sub(rf"(?<!{_L})({_L}(?:\.|(?!{_L})(?!['’]{_L})))|{_ANY_WORD}", named, mention)
    made = found[0][2] if found else ""
    if kind == "EMAIL":
        return made.upper() if mention.isupper() else made
    if kind == "ADDRESS":
        words = made.split(" ")
        if len(re.findall(r"\w+", mention)) != len(words):  # invisible characters inside its words
            return made
        left = iter(words)

        def swapped(m: re.Match) -> str:
            new = next(left)
            if fold(m.group()) in _STREET_WORDS:
                return m.group()
            if any(c.isdigit() for c in m.group()):  # a code keeps its capitals
                return "".join(n.upper() if o.isupper() else n for n, o in zip(new, m.group()))
            return cased(new, m.group())

        return re.sub(r"\w+", swapped, mention)
    chars = iter(made)
    if kind == "PHONE" and not re.search(r"\d", mention):
        back = {v: k for k, v in DIGIT_WORDS.items() if k not in {"zero", "nought"}}
        return re.sub("[A-Za-z]+", lambda m: back.get(next(chars, "0"), m.group()) if m.group().lower() in DIGIT_WORDS else m.group(), mention)
    if kind == "PHONE":
        return re.sub(r"\d", lambda m: next(chars, m.group()), mention)
    return re.sub(r"[^\W_]", lambda m: next(chars, m.group()), mention)


def mentions(docs: DataFrame, name_parts: DataFrame | None = None, everything: bool = False, max_parts: int = 200_000) -> DataFrame:
    """(src_table, row_id, text, mentions) of the texts that mention anything, or of all texts; ``docs`` has (src_table, row_id, text).

    The list of name parts is read to the driver and refused beyond ``max_parts`` rows.
    """
    known: list = [] if name_parts is None else name_parts.select("part", "kind").where("part IS NOT NULL").limit(max_parts + 1).collect()
    if len(known) > max_parts:
        raise ValueError("too many name parts for a list in memory")
    given, family = ([r.part for r in known if r.kind == kind] for kind in ("given", "family"))
    texts = docs.select("src_table", F.col("row_id").cast("string").alias("row_id"), "text")
    return texts.mapInPandas(_scan(given, family, everything), f"src_table string, row_id string, text string, mentions {_MENTIONS}")


def _draws(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [draw(key, k, e, int(a), None if w is None else bool(w)) for k, e, a, w in zip(batch["kind"], batch["entity"], batch["attempt"], batch["woman"].astype(object).where(batch["woman"].notna(), None))]
            yield batch[["kind", "entity", "attempt", "woman"]].assign(surrogate=made)

    return run


_DRAWN = "kind string, entity string, attempt int, woman boolean, surrogate string"


def assign(entities: DataFrame, key: bytes, rounds: int = 16) -> DataFrame:
    """(kind, entity, surrogate) of (kind, entity, woman): no two entities of a kind share a surrogate, and as far as there is room none is a real entity.

    All draw at once; a distributed check finds draws that collide, of which the least
    entity keeps its own, and those that are real entities; these draw again, and
    may then take nothing that anybody drew at first. Numbers are permuted, so that first
    draws never collide: where nearly all numbers of a format are in use they keep them
    after the last round, though somebody really has that number.
    """
    first = cut(entities.withColumn("attempt", F.lit(0)).mapInPandas(_draws(key), _DRAWN))
    real = entities.select("kind", F.col("entity").alias("surrogate"))
    taken = first.select("kind", "surrogate").unionByName(real).distinct()
    marked = first.join(real.withColumn("is_real", F.lit(True)), ["kind", "surrogate"], "left")
    keeper = first.groupBy("kind", "surrogate").agg(F.min("entity").alias("keeper"))
    checked = cut(marked.join(keeper, ["kind", "surrogate"]).select("kind", "entity", "woman", "attempt", "surrogate", F.coalesce("is_real", F.lit(False)).alias("is_real"), (F.col("entity") != F.col("keeper")).alias("shared")))
    good = [checked.where("NOT is_real AND NOT shared").select("kind", "entity", "surrogate")]
    bad = checked.where("is_real OR shared")
    again = []
    for k in range(1, rounds + 1):
        if not bad.limit(1).count():
            break
        drawn = cut(bad.select("kind", "entity", "woman", F.lit(k).alias("attempt")).mapInPandas(_draws(key), _DRAWN))
        known = [taken, *[a.select("kind", "surrogate") for a in again]]
        fresh = drawn
        for some in known:
            fresh = fresh.join(some, ["kind", "surrogate"], "left_anti")
        won = cut(fresh.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"))
        again.append(won)
        bad = cut(bad.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti"))
    if bad.where("shared").limit(1).count():
        raise RuntimeError("surrogates still collide")
    return reduce(DataFrame.unionByName, [*good, *again, bad.select("kind", "entity", "surrogate")])


def _rewrite(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            redacted, surrogate, types = [], [], []
            for text, found, made in zip(batch["text"], batch["mentions"], batch["made"]):
                known = {(m["kind"], m["entity"]): m["surrogate"] for m in made}
                plain, secret, at, seen = [], [], 0, {}
                for m in sorted(found, key=lambda m: m["start"]):
                    own = [(p["kind"], p["entity"], known[p["kind"], p["entity"]]) for p in m["parts"] if (p["kind"], p["entity"]) in known]
                    plain += [text[at : m["start"]], f"[{m['pii_type']}]"]
                    secret += [text[at : m["start"]], render(text[m["start"] : m["stop"]], m["pii_type"], own, key)]
                    at = m["stop"]
                    if own:
                        seen[m["pii_type"]] = None
                redacted.append("".join([*plain, text[at:]]))
                surrogate.append("".join([*secret, text[at:]]))
                types.append(list(seen))
            yield batch[["src_table", "row_id"]].assign(redacted=redacted, surrogate=surrogate, pii_types=types)

    return run


def pseudonymise(docs: DataFrame, key: bytes, name_parts: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """(src_table, row_id, redacted, surrogate, pii_types) of the texts with mentions, or of all texts; those without stay as they are.

    Whoever has ``key`` can do the mapping again, so keep it as secret as the texts.
    Entities are counted map-side before anything is shuffled; the way back is one
    join on the entity, frequent ones by broadcast, and one grouping per text.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    scanned = cut(mentions(docs, name_parts, everything))
    found = scanned.where(F.size("mentions") > 0)
    parts_of = F.transform("mentions", lambda m: m["parts"])
    keyed = found.withColumn("text_key", F.md5(F.encode("text", "utf-8")))
    used = keyed.select("text_key", F.explode(F.array_distinct(F.flatten(parts_of))).alias("p")).select("text_key", "p.kind", "p.entity", "p.hint")
    # what titles say of a given name anywhere holds everywhere, so that one person has one surrogate
    woman = F.when(F.sum("hint") > 0, True).when(F.sum("hint") < 0, False)
    counted = cut(used.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n"), woman.alias("woman")))
    made = cut(assign(counted.select("kind", "entity", "woman"), key).join(counted.select("kind", "entity", "n"), ["kind", "entity"]))
    per_text = join_hot(used.drop("hint"), made, ["kind", "entity"], "n").groupBy("text_key").agg(F.collect_set(F.struct("kind", "entity", "surrogate")).alias("made"))
    ready = keyed.join(per_text, "text_key").select("src_table", "row_id", "text", "mentions", "made")
    rewritten = ready.mapInPandas(_rewrite(key), "src_table string, row_id string, redacted string, surrogate string, pii_types array<string>")
    if not everything:
        return rewritten
    same = scanned.where(F.coalesce(F.size("mentions"), F.lit(0)) <= 0)
    return rewritten.unionByName(same.select("src_table", "row_id", F.col("text").alias("redacted"), F.col("text").alias("surrogate"), F.array().cast("array<string>").alias("pii_types")))


def types_found(rewritten: DataFrame) -> DataFrame:
    """One row per record and type that was replaced in it."""
    return rewritten.select("src_table", "row_id", F.explode("pii_types").alias("pii_type")).distinct()


def gather(spark: SparkSession, tables: list[tuple[str, DataFrame, str | Column, str]]) -> DataFrame:
    """(src_table, row_id, text) of several tables (name, rows, id column, text column)."""
    out = None
    for name, df, row_id, text in tables:
        one = df.select(F.lit(name).alias("src_table"), F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
