"""Reading a sentence left to right: people, the words between them, and whom each kin word is about.

People are links and names that a lexicon knows. The words before a person are matched against a table of phrases; every
phrase that ends right before the person is a reading with its span of characters, and the longest span wins, so "his
father's brother" is never his father. Whom a phrase is about is found on a stack: each open bracket has a frame, whose
owner is the person that stands before it, and each frame keeps the person named last in it and whether that one was an
object (of "of", "to" or a marriage) or can be a subject. A relative clause between commas is passed over, and what stands
between an owner and its bracket is description. In a line of a list, the person it begins with is its head, to whom all
that cannot be about anybody nearer refers, to the end of the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

from kinloom.functions import text as tx
from kinloom.functions.names import HONORIFICS, SUFFIXES

# Kin words, what they say, and how sure they are.
OF = {  # X, <word> של Y: (relation, the ends it runs from and to, confidence)
    "child_of": (("בנו", "בנה", "בתו", "בתה", "בנם", "בתם"), "parent", "SR", 0.7),
    "parent_of": (("אביו", "אמו", "אביה", "אמה", "אביהם", "אמם"), "parent", "RS", 0.7),
    "spouse_of": (("אשתו", "אישתו", "רעייתו", "זוגתו", "בעלה", "אלמנתו"), "spouse", "SR", 0.8),
    "sibling_of": (("אחיו", "אחותו", "אחיה", "אחותה", "אחיהם", "אחותם"), "sibling", "SR", 0.8),
    "grandparent_of": (("נכדו", "נכדתו", "נכדם", "נכדתם"), "grandparent", "SR", 0.75),
    "great_grandparent_of": (("נינו", "נינתו"), "great_grandparent", "SR", 0.75),
    "grandparent_rev": (("סבו", "סבתו", "סבה", "סבתה"), "grandparent", "RS", 0.7),
    "child_in_law_of": (("חתנו", "כלתו", "חתנם", "כלתם"), "parent_in_law", "SR", 0.8),
    "sibling_in_law_of": (("גיסו", "גיסתו", "גיסה", "גיסם"), "sibling_in_law", "SR", 0.7),
    "uncle_of": (("דודו", "דודתו", "דודה", "דודם"), "uncle", "RS", 0.7),
    "nephew_of": (("אחיינו", "אחייניתו", "אחיינה", "אחיינם"), "uncle", "SR", 0.7),
}
IS = {  # <word>, Y: the page's person stands for the subject
    "parent_is": (("אביו", "אמו", "אביה", "אמה"), "parent", "SR", 0.8),
    "spouse_noun": (("אשתו", "אישתו", "רעייתו", "זוגתו", "בעלה"), "spouse", "SR", 0.8),
    "sibling_is": (("אחיו", "אחותו", "אחיה", "אחותה"), "sibling", "SR", 0.75),
    "child_is": (("בנו", "בתו", "בנם", "בתם", "בנה", "בתה"), "parent", "RS", 0.75),
    "grandparent_is": (("סבו", "סבתו", "סבה", "סבתה"), "grandparent", "SR", 0.75),
    "parent_in_law_is": (("חותנו", "חמיו", "חמותו", "חותנתו", "חמיה", "חמותה"), "parent_in_law", "SR", 0.8),
    "child_in_law_is": (("חתנו", "כלתו", "חתנם", "כלתם"), "parent_in_law", "RS", 0.75),
    "uncle_is": (("דודו", "דודתו"), "uncle", "SR", 0.7),
}
MARRIAGE_INSERTS = (r"\s+לאי?שה", r"\s+בזיווג\s+\S+")  # patterns of what may stand between the verb and its preposition
SPOUSE_VERBS = ("נשוי", "נשואה", "נישא", "נישאה", "התחתן", "התחתנה", "נשא", "נשאה")
CONSTRUCT = {  # X, <word> Y, without "of"
    "spouse_construct": (("אשת", "רעיית", "אלמנת"), "spouse", "SR", 0.8),
    "child_construct": (("בן", "בת"), "parent", "SR", 0.7),
    "son_in_law_of": (("חתן", "כלת"), "parent_in_law", "SR", 0.75),
}
MARRIED_DAUGHTER = (("בתו", "בת", "בתה"), "parent_in_law", "SR", 0.75)  # behind a verb of marriage
LISTS = {  # <word>: Y, Z and W
    "children_list": (("ילדיו", "ילדיה", "ילדיהם", "בניו", "בנותיו", "בניהם", "בנותיהם", "צאצאיו", "צאצאיהם"), "parent", "RS", 0.75),
    "siblings_list": (("אחיו ואחיותיו", "אחיו", "אחיותיו", "אחיה", "אחיותיה"), "sibling", "SR", 0.7),
}
LIST_ROLES = {  # in lines of lists: the person of the line is this to the page's person
    "child": (("בנו", "בתו", "בנם", "בתם", "בנה", "בתה"), "parent", "RS"), "child_in_law": (("חתנו", "כלתו", "חתנם", "כלתם"), "parent_in_law", "RS"),
    "sibling": (("אחיו", "אחותו", "אחיה", "אחותה"), "sibling", "SR"), "parent": (("אביו", "אמו", "אביה", "אמה"), "parent", "SR"),
    "spouse": (("אשתו", "בעלה", "רעייתו", "זוגתו"), "spouse", "SR"), "grandparent": (("סבו", "סבתו", "סבה", "סבתה"), "grandparent", "SR"),
    "parent_in_law": (("חותנו", "חמיו", "חמותו", "חותנתו"), "parent_in_law", "SR"), "sibling_in_law": (("גיסו", "גיסתו"), "sibling_in_law", "SR"),
    "uncle": (("דודו", "דודתו"), "uncle", "SR"),
}
LIST_SECTIONS = {  # words of headings and lead-ins, and the role of lines below them
    "child": "ילדי|צאצא|בניו|בנותיו|בני משפחתו", "sibling": "אחיו|אחיותיו", "child_in_law": "חתניו|כלותיו",
}
BORN = ("נולד", "נולדה")
TO_PARENTS = ("אביו", "אביה", "הוריו", "הוריה", "אמו", "אמה", "אימו", "אימה")
NAMED_AFTER = ("על שם", "ע\"ש", "לזכר")
IS_WORDS, PLACE_SIGNS = ("הוא", "היא", "היה", "הייתה", "היתה"), ("ב", "מ")
VERBS = (*IS_WORDS, "היו", *SPOUSE_VERBS, *BORN, "נפטר", "נפטרה", "כיהן", "שימש", "למד", "עלה", "עבר", "מכהן", "משמש")
FEMALE_TITLES = ("הרבנית", "מרת", "גב'", "הגברת")
FEMALE_KIN, MALE_KIN = ("אשת", "בת", "אם", "כלת", "נכדת", "אחות", "אלמנת", "סבת", "דודת", "נינת"), ("בן", "אב", "אבי", "חתן", "נכד", "אח", "בעל", "סב", "דוד", "נין")
GENDERED = {"m": ("נולד", "נפטר", "נישא", "התחתן", "כיהן", "שימש", "למד"), "f": ("נולדה", "נפטרה", "נישאה", "התחתנה", "כיהנה", "שימשה", "למדה")}
INFIXES, MAIDEN = ("סג\"ל", "הכהן", "הלוי"), ("לבית", "למשפחת")  # inside a name; before a maiden name
ASIDE = ("אבי", "אם", "אח", "אחי", "אחות", "דוד", "דודת", "גיס", "גיסת", "חותן", "חותנת", "סב", "סבת", "בן", "בת")  # before "his father": not the father
GRANDPARENTS, UNCLES = ("אבי", "אם"), ("אח", "אחי", "אחות", "דוד", "דודת")
PARENT_WORDS = ("אביו", "אמו", "אביה", "אמה", "אימו", "אימה")
SIDES = ("אביו", "אמו", "אביה", "אמה", "האב", "האם")
BETWEEN = ("בין",)
MONTHS = ("תשרי", "חשוון", "חשון", "מרחשוון", "מרחשון", "כסלו", "טבת", "שבט", "אדר", "ניסן", "אייר", "סיוון", "סיון", "תמוז", "אב", "מנחם אב", "אלול")
FEASTS = ("ראש השנה", "יום כיפור", "יום הכיפורים", "סוכות", "שמחת תורה", "חנוכה", "פורים", "פסח", "שבועות", "תשעה באב", "ל\"ג בעומר", "שבת", "שבת קודש")
STOP_WORDS = ("של", "אשר", "היה", "הייתה", "הוא", "היא", "את", "על", "עם", "אצל", "וכן", "גם", "כי", "אך", "אבל", "לבית")
BORN_TO, SPOUSE_VERB = 0.85, 0.85
LINKED, UNLINKED, LIST_LINKED, LIST_UNLINKED = 0.9, 0.7, 0.8, 0.6
NO_ARTICLE = 0.15  # an unlinked end costs so much

_LETTERS = "א-ת"


def any_of(words) -> str:
    return _any_of(tuple(words))


@cache  # the same few tables of words for every line
def _any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


def word(words) -> str:
    return f"(?<![{_LETTERS}]){any_of(words)}(?![{_LETTERS}])"


TITLES = rf"(?:{any_of(HONORIFICS)}\s+)*"
ORDINAL = rf"(?:\s+ה[{_LETTERS}]+)?"
_OPEN = rf"(?<![{_LETTERS}])ו?"  # a word, or one with "and" before it


@dataclass(frozen=True)
class Phrase:
    """Words right before a person that make it a relative. ``kind``: of, construct, verb (the words before them tell whom
    they are about), is or list (the person of the page or line); ``chain``: also about the object of another phrase;
    ``explicit``: only about somebody named; ``side``: group of the pattern that tells the side of a grandparent."""

    name: str
    pattern: re.Pattern
    relation: str | None
    direction: str
    confidence: float
    kind: str
    chain: bool = False
    explicit: bool = False


def phrases() -> list[Phrase]:
    def ends(body: str) -> re.Pattern:
        return re.compile(body + rf"\s*(?:,\s*)?{TITLES}$")

    is_ = rf"(?:\s*[,:]?\s*{any_of(IS_WORDS)}(?![{_LETTERS}]))?"
    table = []
    marry = word(SPOUSE_VERBS) + "".join(f"(?:{insert})?" for insert in MARRIAGE_INSERTS)
    table.append(Phrase("married_daughter_of", ends(rf"{marry}\s+(?:(?:את|עם)\s+|ל)?{any_of(MARRIED_DAUGHTER[0])}(?:\s+של)?"), *MARRIED_DAUGHTER[1:], "verb"))
    table.append(Phrase("spouse_verb", ends(rf"{marry}\s+(?:ל|עם\s|את\s)"), "spouse", "SR", SPOUSE_VERB, "verb"))
    between = rf"(?:\s+{any_of(PARENT_WORDS)})?"  # "daughter of her father, X"
    for name, (words, relation, way, sure) in OF.items():
        table.append(Phrase(name, ends(_OPEN + any_of(words) + ORDINAL + r"\s+של" + (between if name == "child_of" else "")), relation, way, sure, "of", chain=name == "child_of"))
    for name, (words, relation, way, sure) in CONSTRUCT.items():
        table.append(Phrase(name, ends(_OPEN + any_of(words) + r"(?:\s+של)?"), relation, way, sure, "construct", chain=name != "spouse_construct", explicit=name == "child_construct"))
    mothers = IS["parent_is"][0] + ("אימו", "אימה")
    for name, (words, relation, way, sure) in IS.items():
        table.append(Phrase(name, ends(_OPEN + any_of(mothers if name == "parent_is" else words) + ORDINAL + is_), relation, way, sure, "is"))
    for name, (words, relation, way, sure) in LISTS.items():
        table.append(Phrase(name, ends(_OPEN + any_of(words) + r"\s*(?:הם|הן|היו)?\s*[:,]?"), relation, way, sure, "list"))
    # composite kin: what stands before "his father" decides, and most of it is no relation of ours
    parents = any_of(PARENT_WORDS)
    table.append(Phrase("grandparent_is", ends(rf"{_OPEN}{any_of(GRANDPARENTS)}\s+(?P<side>{parents}){is_}"), "grandparent", "SR", IS["grandparent_is"][3], "is"))
    table.append(Phrase("grandparent_is", ends(rf"{_OPEN}{any_of(IS['grandparent_is'][0])}\s+מצד\s+(?P<side>{any_of(SIDES)}){is_}"), "grandparent", "SR", IS["grandparent_is"][3], "is"))
    table.append(Phrase("uncle_is", ends(rf"{_OPEN}{any_of(UNCLES)}\s+{parents}{is_}"), "uncle", "SR", IS["uncle_is"][3], "is"))
    table.append(Phrase("", ends(rf"{_OPEN}{any_of(set(ASIDE) - set(GRANDPARENTS) - set(UNCLES))}\s+{parents}{is_}"), None, "", 0, "is"))
    table.append(Phrase("", ends(rf"מצד\s+{any_of(SIDES)}"), None, "", 0, "is"))
    return table


TRIGGER = any_of({w for words, *_ in (*OF.values(), *IS.values(), *CONSTRUCT.values(), *LISTS.values(), MARRIED_DAUGHTER) for w in words} | set(SPOUSE_VERBS) | set(BORN) | set(PARENT_WORDS))
_KIN = {w for words, *_ in (*OF.values(), *IS.values(), *CONSTRUCT.values(), *LISTS.values(), *LIST_ROLES.values()) for w in words} | set(TO_PARENTS)
_BORN = re.compile(word(BORN) + rf"[^.]*(?<![{_LETTERS}])ל{any_of(TO_PARENTS)}?\s*,?\s*{TITLES}$")
_AND = re.compile(rf"\s*,?\s*ו(?:של\s|-|ל)?\s*{any_of(TO_PARENTS)}?\s*,?\s*{TITLES}$")
_ITEM = re.compile(rf"\s*(?:,|ו|,\s*ו|ו-)\s*{TITLES}$")
_BESIDE = re.compile(rf"^\s*[,–-]?\s*(?:{any_of(IS_WORDS)}\s+)?$")
_CLAUSE = re.compile(r"^\s*,\s*(?:ש[^,]*|אשר\s[^,]*),\s*$")  # ", who was ...,"
_LINK = re.compile(r"\[\[([^\[\]|#]+?)(?:#[^\[\]|]*)?(?:\|[^\[\]]*)?\]\]")
_TITLED = re.compile(rf"(?:^|[\s,;:(–*#-])(?:ו?[לבמ]?)((?:{any_of(HONORIFICS)}\s+)+)$")
_PLACE = re.compile(r"(?<![א-ת])[בלמ]$")  # "in [[town]]"
# Fixed value: what years, days and feasts look like.
YEAR = re.compile(
    rf"(?:ה')?ת[{_LETTERS}]{{0,3}}\"[{_LETTERS}]|\d{{3,4}}|שנת .*|[{_LETTERS}]{{1,2}}\"[{_LETTERS}]|\d{{1,2}} ב[{_LETTERS}]+|{any_of(FEASTS)}"
    rf"|(?:(?:[{_LETTERS}]'|[{_LETTERS}]\"[{_LETTERS}]|[{_LETTERS}]{{1,2}})\s*ב?)?{any_of(MONTHS)}(?:\s+[אב]')?(?:\s+(?:ה')?ת[{_LETTERS}]{{0,3}}\"[{_LETTERS}])?"
)


def looks_like_year(name: str) -> bool:
    """Whether a name is in truth a year, a number, a day or a feast."""
    return YEAR.fullmatch(name.strip().replace("״", '"').replace("׳", "'")) is not None


# What a word may be in a name, and where each word leads: (state, class) -> (next state, whether the word is taken).
# States: start, given (a first name stands), rare (and one word nobody knows), family (a surname stands), maiden, end.
NAME_STATES = {
    ("start", "title"): ("start", False), ("start", "given"): ("given", True), ("start", "known"): ("given", True), ("start", "last"): ("family", True),
    ("given", "given"): ("given", True), ("given", "known"): ("given", True), ("given", "infix"): ("given", True), ("given", "last"): ("family", True),
    ("given", "rare"): ("rare", True), ("given", "suffix"): ("given", False), ("given", "maiden"): ("maiden", False),
    ("rare", "last"): ("family", True), ("rare", "suffix"): ("rare", False), ("rare", "maiden"): ("maiden", False),
    ("family", "last"): ("family", True), ("family", "suffix"): ("family", False), ("family", "maiden"): ("maiden", False),
    ("maiden", "last"): ("end", True), ("maiden", "known"): ("end", True), ("maiden", "given"): ("end", True), ("maiden", "rare"): ("end", True),
}


@dataclass(frozen=True)
class Lexicon:
    """Words of names in titles: given (first words), last (last words that are no given names), all; and words that are
    too common in texts to be names. Without common words, words that nobody knows are no part of a name."""

    given: frozenset = frozenset()
    last: frozenset = frozenset()
    every: frozenset = frozenset()
    common: frozenset = frozenset()

    def kind(self, w: str, first: bool, titled: bool) -> str:
        known = "given" if w in self.given else "last" if w in self.last else "known" if w in self.every else ""
        if w in HONORIFICS:
            return "title"
        if w in SUFFIXES:
            return "suffix"
        if w in MAIDEN:
            return "maiden"
        if w in INFIXES:
            return "infix"
        if known and (first or w not in STOP_WORDS) and w not in _KIN:
            return known
        if w in STOP_WORDS or w in self.common or w in _KIN or re.sub("^ו(?:ל|של)?", "", w) in _KIN or w in VERBS:
            return "stop"
        if not re.fullmatch(rf"[{_LETTERS}][{_LETTERS}'\"-]*", w) or looks_like_year(w):
            return "stop"
        if w.startswith("מ") and len(w) > 3:
            return "place"  # most likely where somebody is from
        return "rare" if self.common or titled and first else "stop"

    def name(self, text: str, titled: bool) -> str:
        """The name that ``text`` begins with, or nothing: given or titled first, then on while words are names."""
        return self.read(text, titled)[0]

    def read(self, text: str, titled: bool) -> tuple[str, int]:
        """(name, where it ends in ``text``)."""
        state, taken, end = "start", [], 0
        words = list(re.finditer(r"\S+", text))
        for n, m in enumerate(words):
            bare = m.group().strip("(),.;:'[]")
            kind = self.kind(bare, not taken, titled) if bare and m.group()[0] not in "([" else "stop"
            if state == "start" and kind in ("rare", "place"):
                after = words[n + 1].group().strip("(),.;:'") if n + 1 < len(words) and bare == m.group() else ""
                kind = "known" if titled and kind == "rare" or after in self.last else "stop"  # nobody's name, but a surname follows
            elif state == "start" and kind == "known" and not titled and (n + 1 == len(words) or words[n + 1].group().strip("(),.;:'") not in self.last):
                kind = "stop"
            state, take = NAME_STATES.get((state, kind), ("end", False))
            if take:
                taken.append(f"{MAIDEN[0]} {bare}" if words[n - 1].group() in MAIDEN and taken else bare)
                end = m.start() + m.group().index(bare) + len(bare)
            if state == "end" or m.group()[-1] in "(),.;:]" and not (take and bare == m.group()):
                break
        if not taken or not titled and len(taken) == 1 and (taken[0] not in self.given or taken[0].startswith("ה")):
            return "", 0
        return " ".join(taken), end


@dataclass
class Mention:
    """A person in a text: where it stands, the words since the one before, the gender of its title."""

    id: str
    gap: str
    start: int
    end: int
    gender: str | None = None
    titled: bool = False
    doubtful: bool = False
    object: bool = field(default=False)
    anchored: bool = field(default=False)  # a phrase, or the beginning of a clause, speaks for it


@dataclass(frozen=True)
class Found:
    """A relation and the characters that tell it."""

    person: str
    relative: str
    relation: str
    pattern: str
    confidence: float
    start: int
    end: int
    side: str | None = None
    doubtful: bool = False


def title_gender(before: str) -> tuple[bool, str | None]:
    """(whether a title stands right before, its gender)."""
    m = _TITLED.search(before)
    return (False, None) if m is None else (True, "f" if any(w in FEMALE_TITLES for w in m.group(1).split()) else "m")


_NAME_START = re.compile(
    rf"(?:{_OPEN}{any_of(_KIN)}{ORDINAL}(?:\s+של)?(?:\s+{any_of(PARENT_WORDS)})?(?:\s+{any_of(IS_WORDS)})?|(?<![{_LETTERS}])(?:ו?ל|ו|ו?של\s+)?{any_of(TO_PARENTS)}"
    rf"|{word(SPOUSE_VERBS)}(?:{MARRIAGE_INSERTS[0]})?\s+(?:ל|עם\s|את\s)|(?<![{_LETTERS}])(?:ו?[לב])?(?={any_of(HONORIFICS)}\s))"
    rf"\s*,?\s*(?P<title>{TITLES})(?=[{_LETTERS}])"
)
_HEAD = re.compile(rf"^[*#:;\s]+(?:{any_of(_KIN)}(?![{_LETTERS}]){ORDINAL}\s*,?\s*)?(?P<title>{TITLES})(?=[{_LETTERS}])")


def mentions(text: str, lexicon: Lexicon, known: frozenset | None = None) -> list[Mention]:
    """People of a text in order. Years, links into other spaces, and links behind a letter "in" are none; with ``known``
    (pages of people), a link to another page is doubtful, unless a title stands before it."""
    out: list[Mention] = []
    at = 0

    def names(upto: int) -> None:
        nonlocal at
        if not lexicon.every:
            return
        seek = at
        while seek < upto:
            m = (_HEAD.match(text, 0, upto) if not seek and text[:1] in "*#" else None) or _NAME_START.search(text, seek, upto)
            if m is None:
                return
            name, end = lexicon.read(text[m.end() : upto], bool(m.group("title")))
            if not name or looks_like_year(name):
                seek = max(m.end(), seek + 1)
                continue
            titled, gender = title_gender(text[: m.end()])
            out.append(Mention("~" + name, text[at : m.end()], m.end(), m.end() + end, gender, titled))
            at = seek = m.end() + end

    for link in _LINK.finditer(text):
        target = page_title(link.group(1))
        names(link.start())
        titled, gender = title_gender(text[: link.start()])
        thing = any(target.lower().startswith(ns) for ns in tx.SKIPPED_NAMESPACES) or looks_like_year(target)
        doubt = known is not None and target not in known and not titled
        if thing or not titled and _PLACE.search(text[: link.start()]) and not (text[link.start() - 1] == "ל" and (known is None or target in known)):
            continue
        out.append(Mention(target, text[at : link.start()], link.start(), link.end(), gender, titled, doubt))
        at = link.end()
    names(len(text))
    return out


def page_title(target: str) -> str:
    return re.sub(r"\s+", " ", target.strip().replace("_", " "))


def reading(table: list[Phrase], gap: str) -> tuple[Phrase, re.Match] | None:
    """The phrase at the end of ``gap`` with the longest span; the first in the table of equal ones."""
    hits = [(m.start(), k, p, m) for k, p in enumerate(table) if (m := p.pattern.search(gap))]
    return min(hits, key=lambda h: h[:2])[2:] if hits else None


@dataclass
class _Frame:
    owner: Mention | None = None
    last: Mention | None = None


def read_text(page: str, text: str, table: list[Phrase], lexicon: Lexicon = Lexicon(), known: frozenset | None = None) -> Iterator[Found]:
    """Relations of one sentence of the page, or of one line of a list."""
    text = re.sub(rf"{any_of(NAMED_AFTER)}[^,.]*", lambda m: " " * len(m.group()), text)
    text = _LINK.sub(lambda m: " " * len(m.group()) if looks_like_year(page_title(m.group(1))) else m.group(), text)
    people = mentions(text, lexicon, known)
    in_list, frames = text[:1] in "*#", [_Frame()]
    said: tuple[str, Phrase, int, str | None] | None = None  # what "and" goes on with
    born = False

    def tell(subject: str, phrase: Phrase, now: Mention, start: int, side: str | None) -> Iterator[Found]:
        a, b = (subject, now.id) if phrase.direction == "SR" else (now.id, subject)
        if a != b and phrase.relation:
            sure = phrase.confidence - (NO_ARTICLE if now.id.startswith("~") else 0)
            yield Found(a, b, phrase.relation, phrase.name, sure, start, now.end, side, now.doubtful)

    for k, now in enumerate(people):
        fresh = True  # nobody named since the bracket opened
        tail_at = 0
        for at, sign in enumerate(now.gap):
            if sign == "(":
                frames.append(_Frame(owner=frames[-1].last))
                tail_at = at + 1
            elif sign == ")" and len(frames) > 1:
                frames.pop()
                tail_at = at + 1
        frame = frames[-1]
        fresh = frame.last is None and frame.owner is not None
        before = frame.owner if fresh else frame.last
        tail = now.gap[tail_at:]
        base = now.start - len(tail)
        if re.search(r"[.;!?]\s", tail):
            before = None  # another sentence of the line
        if said and (_AND if said[1].kind != "list" else _ITEM).match(now.gap) and said[1].relation in ("parent", "sibling"):
            yield from tell(said[0], said[1], now, said[2], said[3])
            now.object, now.anchored = said[1].kind not in ("is", "list"), True
            frame.last = now
            continue
        said = None
        hit = reading(table, tail)
        if hit is None and not born and (m := _BORN.search(text[: now.start])) and not word_in(BETWEEN, text[m.start() : now.start]):
            hit, born = (Phrase("born_to", _BORN, "parent", "SR", BORN_TO, "born"), m), True
            base = 0
        if hit is None:
            now.anchored = _BESIDE.match(re.sub(rf"{TITLES}$", "", re.split(r"[,;:()–]|\.\s|^[*#]+", tail)[-1].lstrip("ו "))) is not None
            if now.anchored or not (frame.last and frame.last.anchored):
                frame.last = now
            continue
        phrase, m = hit
        start = base + m.start()
        prefix = tail[: m.start()] if phrase.kind != "born" else ""
        near = before is not None and (_BESIDE.match(prefix) is not None or _CLAUSE.match(prefix) is not None or fresh and not prefix.strip())
        head = people[0].id if in_list and k else page
        subject = head
        if phrase.kind in ("of", "construct", "verb"):
            if near and (fresh or not before.object or phrase.chain):
                subject = before.id
            elif phrase.explicit and not (in_list and k):
                frame.last, now.object = now, True
                continue
        elif phrase.relation == "spouse" and near and not in_list and m.group().lstrip().startswith("ו") and before.object:
            subject = before.id  # "to his parents X and his wife Y"
        if phrase.kind == "list" and not in_list:
            subject = page
        side = side_of(m)
        yield from tell(subject, phrase, now, start, side)
        now.object, now.anchored = phrase.kind not in ("is", "list"), True
        frame.last = now
        said = (subject, phrase, start, side) if phrase.kind == "list" or phrase.relation in ("parent", "sibling") else None


def word_in(words: tuple[str, ...], text: str) -> bool:
    return re.search(word(words), text) is not None


def side_of(m: re.Match) -> str | None:
    said = m.groupdict().get("side")
    return None if not said else "father" if said.lstrip("ה").startswith("אב") else "mother"


def read_list_line(page: str, line: str, context: str, lexicon: Lexicon = Lexicon(), known: frozenset | None = None) -> Iterator[Found]:
    """What a line of a list says about its head and those set beside it: by a kin word before or right after the head,
    else by the heading or lead-in ``context``."""
    people = mentions(line, lexicon, known)
    if not people:
        return
    head = people[0]
    before = re.sub(r"^[*#:;\s]+", "", line[: head.start])
    if re.search(r"\sשל\s|\s[–-]\s|[.(]", before):  # the person of the line is somebody else
        return
    after = re.split(r"[,.;:()]", line[head.end :].lstrip(" –-,"), maxsplit=1)[0]
    role = next((n for n, (w, *_) in LIST_ROLES.items() if re.search(word(w) + r"(?!\s+של)", before)), None)
    role = role or next((n for n, (w, *_) in LIST_ROLES.items() if re.match(r"\s*(?:הוא|היא)?\s*" + word(w) + r"(?!\s+של)", after)), None)
    role = role or next((n for n, words in LIST_SECTIONS.items() if re.search(words, context)), None)
    if role is None:
        return
    _, relation, direction = LIST_ROLES[role]
    for k, now in enumerate(people):
        if k and not _ITEM.fullmatch(now.gap):
            break
        if now.id == page:
            continue
        a, b = (page, now.id) if direction == "SR" else (now.id, page)
        sure = LIST_UNLINKED if now.id.startswith("~") else LIST_LINKED
        yield Found(a, b, relation, f"list:{role}", sure, 0, now.end, None, now.doubtful)


def read_line(page: str, line: str, context: str, table: list[Phrase], lexicon: Lexicon = Lexicon(), known: frozenset | None = None) -> Iterator[tuple[str, Found]]:
    """(sentence, relation) of a line of running text, sentence by sentence, or of a line of a list as a whole."""
    if line[:1] in "*#":
        spoken = list(read_text(page, line, table, lexicon, known))
        listed = [f for f in read_list_line(page, line, context, lexicon, known)]
        same = {(f.person, f.relative, f.relation) for f in spoken}
        for f in (*spoken, *(f for f in listed if (f.person, f.relative, f.relation) not in same)):
            yield line, f
        return
    at = 0
    for sentence in tx.sentence_list(line):
        begin = line.find(sentence, at)
        at = max(begin, at)
        for f in read_text(page, sentence, table, lexicon, known):
            yield sentence, replace(f, start=f.start + at, end=f.end + at)
        at += len(sentence)


_HEADING, _LEAD_IN = re.compile(r"==+.*==+\s*$"), re.compile(r"[^*#].*:\s*$")
_TELLS = re.compile(TRIGGER)


def read_page(page: str, text: str, table: list[Phrase], lexicon: Lexicon = Lexicon(), known: frozenset | None = None) -> Iterator[tuple[int, str, list[str], Found]]:
    """(row, sentence, footnotes, relation) of a whole page, as a scan over its lines: the last heading or lead-in that ends
    in a colon is what lists below it are about."""
    text = text.translate(str.maketrans("״׳’“”", "\"''\"\""))
    text = tx.strip_template_text(re.sub(tx.COMMENT, "", text))
    notes = [m.group() for m in re.finditer(tx.REF, text)]
    number = iter(range(len(notes)))
    context = ""
    for row, line in enumerate(re.sub(tx.REF, lambda _: f"\0R{next(number)}\0", text).split("\n")):
        if _HEADING.match(line):
            context = line.replace("=", "").strip()
        elif _LEAD_IN.match(line):
            context = line
        if line[:1] in "*#" and line or _TELLS.search(line):
            for sentence, f in read_line(page, re.sub("\0R\\d+\0", "", line), context, table, lexicon, known):
                yield row, sentence, [notes[i] for i in notes_of(line, sentence)], f


def notes_of(line: str, sentence: str) -> list[int]:
    """Numbers of the footnote marks in the part of ``line`` that, without marks, is ``sentence``."""
    plain, marks = "", []
    for part in re.split("(\0R\\d+\0)", line):
        if part.startswith("\0R"):
            marks.append((len(plain), int(part[2:-1])))
        else:
            plain += part
    start = plain.find(sentence)
    return [n for at, n in marks if start < at <= start + len(sentence)]
