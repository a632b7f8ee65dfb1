"""Problem 4: sentence boundaries across languages and scripts.

The rules follow the standard sentence-break rules of Unicode text segmentation: sentence-terminal characters
of every script (taken from the character property, not from a list of languages), closing punctuation that
belongs to the sentence, numbers, continuation marks and lower-case continuations. They are tailored by the
abbreviations of the paragraph's language (told by script and frequent words; where it stays unknown, those of all
languages), by quotations and brackets that stay inside their sentence, by blank lines and by Thai, which
ends sentences with a space.

Defined cases: a NULL or blank text has no sentence; a text without any end inside is one sentence; the last
sentence of a paragraph ends with the paragraph, with or without a mark. Time is linear in the text's length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations (without the last full stop) by language. Titles point at what follows and never end a
# sentence; numbered ones bind a number only; final ones may also stand at the end of a sentence.
TITLES = {
    "en": "mr mrs ms messrs dr prof rev hon st fr capt col gen lt maj sgt cmdr gov sen rep pres mt pp vs cf viz approx ca e.g i.e",
    "de": "hr fr frl dr prof bzw vgl bspw sog evtl inkl exkl zzgl z.b d.h u.a str st ca",
    "fr": "m mr mme mlle mm dr prof st env p.ex c.-à-d éd cf",
    "es": "sr sra srta dr dra prof p.ej avda gral sig ing lic cf",
    "ru": "т.е т.к см напр ул им проф акад ср",
    "hi": "डॉ श्री प्रो सं पृ",
    "ar": "أ.د",
}
NUMBERED = {
    "en": "no nos num fig figs sec sect ch chap vol vols art para eq ed eds",
    "de": "nr abb kap art ed",
    "fr": "no nos fig art vol chap éd",
    "es": "no núm fig art pág págs cap vol",
    "ru": "гл рис табл стр",
    "hi": "",
    "ar": "",
}
FINAL = {
    "en": "etc ltd inc co corp jr bros esq dept est a.m p.m am pm b.c a.d u.s u.k p.s al kg km cm mm lb lbs oz ft hr hrs min sec in yd mi",
    "de": "usw u.s.w usf ggf gmbh co kg km cm mm std min a.d",
    "fr": "etc cie kg km cm mm min h",
    "es": "etc cía pte a.m p.m ud uds ee.uu kg km cm mm min",
    "ru": "г гг в вв руб коп тыс млн млрд др пр т.д т.п и.о",
    "hi": "",
    "ar": "",
}
#: Of these a capital letter tells the title from the word or unit.
CAPITAL = frozenset("st fr rep gen col rev hon gov sen pres maj hr mt ms".split())
#: Titles that follow a name and then may end a sentence, as in Main St.
AFTER_NAME = frozenset("st".split())
#: Measures: behind a number they are units, whatever else they abbreviate.
UNITS = frozenset("mm cm см hr st".split())
# Frequent words that tell the languages written in Latin letters.
FREQUENT = {
    "en": "the of and to is was for with that by from at on it he she they his her its has were are this",
    "de": "der die das und ist nicht ein eine einen im mit von zu auf den dem des wurde bei aus für sich als",
    "fr": "le les des et est une dans du au aux pour qui sur avec il elle par ne pas ce cette",
    "es": "el los las y es una en con del por que para se su al como más fue",
}
TITLES, NUMBERED, FINAL, FREQUENT = ({k: frozenset(v.split()) for k, v in t.items()} for t in (TITLES, NUMBERED, FINAL, FREQUENT))
LATIN = tuple(FREQUENT)
# German month names and their short forms, for dates such as "3. März".
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember "
    "jan feb mär apr jun jul aug sep sept okt nov dez".split()
)

PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "‘": "’", "„": "“", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "‹": "›", "＂": "＂", '"': '"', "〝": "〞", "［": "］"}
CLOSERS = frozenset(PAIRS.values()) | {"”", "’", "'"}
BRACKETS = frozenset("([{（［")
CLOSED_BY = {o: (c, "”") if o == "„" else (c,) for o, c in PAIRS.items()}
#: By what a pending mark is looked for.
PAIR_CLOSERS = frozenset(PAIRS.values())
FULL_STOPS = frozenset(".․﹒．")
DOTS = frozenset("….‥")

EVENT = regex.compile(r"[\p{Sentence_Terminal}…‥．｡]+|[()\[\]{}“”„‘«»「」『』（）【】《》〈〉‹›\"＂〝〞［］]")
THAI_SPACE = regex.compile(r"(?<=[\p{Thai}\p{Nd}\p{Pe}\p{Pf}\"?!.])\s+(?=[\p{Thai}“\"(]\P{Z})")
NEWLINE = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028])"
BLANK_LINE = regex.compile(rf"{NEWLINE}[^\S\n\r]*{NEWLINE}\s*|\u2029\s*")
WORD_BEFORE = regex.compile(r"[^\s(\[{“”„«»「」\"'‘（]+$")
TAG = regex.compile(r"\p{Ll}{1,6}[-_]?\d")
BULLET = regex.compile(r"[-*•–+]\s|\d{1,3}[.)]\s")
NEXT_WORD = regex.compile(r"\p{L}+")
CONTINUE = frozenset(",;:،؛、，；：—–-~→/&+=%")
THAI = regex.compile(r"\p{Thai}")
CYRILLIC = regex.compile(r"\p{Cyrillic}")
LATIN_LETTER = regex.compile(r"\p{Latin}")
NAME_BEFORE = regex.compile(r"\p{Lu}\p{Ll}+\s+$")
NO_SPACE_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
UNCASED = regex.compile(r"\p{Lo}|\p{Lm}")


class Languages:
    """The language of a paragraph by script and frequent words; where it has too few, that of the text; else unknown.

    Only looked up where a word is an abbreviation in some language.
    """

    def __init__(self, text: str) -> None:
        self.text, self.whole, self.spans = text, "?", {}

    @staticmethod
    def _guess(text: str, least: int) -> str | None:
        words = Counter(text.lower().split())
        votes = sorted(((sum(words[w] for w in FREQUENT[k]), k) for k in LATIN), reverse=True)
        return votes[0][1] if votes[0][0] >= votes[1][0] + least else None

    def candidates(self, word: str, start: int, stop: int) -> tuple[str, ...]:
        """Languages in which a word may be an abbreviation."""
        if CYRILLIC.search(word):
            return ("ru",)
        if not LATIN_LETTER.search(word):
            return ("hi", "ar")
        if (start, stop) not in self.spans:
            found = self._guess(self.text[start:stop], 2)
            if found is None:
                if self.whole == "?":
                    self.whole = self._guess(self.text, 1)
                found = self.whole
            self.spans[start, stop] = LATIN if found is None else (found,)
        return self.spans[start, stop]


#: Abbreviations that are words in some language.
FINAL_WORDS = frozenset("am no in art min sec co do para".split())
ABBREVIATIONS = frozenset().union(*TITLES.values(), *NUMBERED.values(), *FINAL.values())


def _abbreviation(text: str, stop: int, low: int, languages: Languages, para: tuple[int, int]) -> str:
    """What the word before a full stop is: an abbreviation that 'never' or 'maybe' ends a sentence, one that binds a
    'number', one that ends a sentence before a 'starter' only, or '' for no abbreviation. No abbreviation has more than 24 characters."""
    found = WORD_BEFORE.search(text, max(low, stop - 24), stop)
    if not found:
        return ""
    word = found.group()
    lower = word.lower()
    before = text[max(low, found.start() - 3) : found.start()].rstrip()
    if lower in ABBREVIATIONS:
        spoken = languages.candidates(lower, *para)
        if lower in UNITS and before[-1:].isdigit():
            return "maybe"
        if any(lower in TITLES[k] for k in spoken):
            if lower in AFTER_NAME and NAME_BEFORE.search(text, max(low, found.start() - 24), found.start()):
                return "starter"
            if word[0].isupper() or lower not in CAPITAL or "es" in spoken:
                return "never"
            return "maybe"
        if any(lower in NUMBERED[k] for k in spoken):
            return "number"
        if any(lower in FINAL[k] for k in spoken):
            return "never" if len(lower) == 1 and not before[-1:].isdigit() else "maybe"
        if len(lower) > 1 and lower not in FINAL_WORDS:
            return "number"  # of another language: a number behind it still belongs to it
    if len(lower) > 2 and lower.endswith(".m") and lower[0] in "ap":
        return "maybe"
    if len(word) == 1 and word.isalpha():
        if NO_SPACE_SCRIPT.match(word) or THAI.match(word):
            return ""
        return "maybe" if word.islower() and before[-1:].isdigit() else "never"
    parts = word.split(".")
    if len(parts) > 1 and all(len(p) == 1 and p.isalpha() for p in parts if p):
        return "maybe" if word.isupper() and len(parts) > 2 else "never"
    return ""


def _ends(text: str, mark: str, a: int, b: int, e: int, begin: int, stop: int, quote: int, languages: Languages, start: int) -> bool:
    """Whether the sentence that began at begin ends at e.

    mark: the terminators at a..b; e: behind their closing marks; stop: the paragraph's end; quote: where the last
    quotation closed behind the marks had opened, or -1.
    """
    k = e
    while k < stop and text[k].isspace():
        k += 1
    if k >= stop:
        return False  # the paragraph's end is an end anyway
    spaced, nxt = k > e, text[k]
    if spaced and "\n" in text[e:k] and BULLET.match(text, k):
        return True
    if nxt in CONTINUE:
        return False
    wide = bool(NO_SPACE_SCRIPT.match(nxt))
    plain = mark[-1] in FULL_STOPS
    dots = len(mark) > 1 and all(c in DOTS for c in mark) or mark in ("…", "‥")
    if quote >= 0:
        if regex.match(r"\p{Hiragana}", nxt):
            return False
        if not text[begin:quote].strip() and nxt not in PAIRS:
            # the sentence opens with the quotation: what follows says whose it is
            if not plain or wide:
                return False
    tag = bool(TAG.match(text, k))
    if nxt.islower() and not tag:
        return False
    if dots:
        return spaced and not wide and not nxt.isdigit() and (quote >= 0 or not text[a - 1 : a].isspace() or nxt.isupper())
    if not plain:
        if THAI.match(nxt):
            return spaced
        return mark[-1] not in "!?" or spaced or wide or quote >= 0 or bool(UNCASED.match(nxt)) or nxt.isupper() or nxt in PAIRS or nxt in "¿¡"
    if e == b:
        kind = _abbreviation(text, a, begin, languages, (start, stop))
        if kind == "never" or (kind == "number" and nxt.isdigit()):
            return False
        if kind == "starter" and not ((word := NEXT_WORD.match(text, k)) and word.group().lower() in FREQUENT["en"]):
            return False
        if not spaced:
            before = text[a - 1 : a]
            if nxt.isdigit() or len(mark) > 1:
                return False
            if kind and not (nxt.isupper() and text[k + 1 : k + 2].islower()):
                return False
            if not (before.isalnum() or before in CLOSERS) or THAI.match(nxt) or (before.isdigit() and not (nxt.isupper() and text[k + 1 : k + 2].islower())):
                return False
            if nxt.isupper():
                return text[k + 1 : k + 2].islower() or text[k + 1 : k + 2] in "'’ ."
            return tag or bool(UNCASED.match(nxt)) or nxt in "¿¡"
        if kind == "maybe" and nxt.isdigit():
            return False
        if text[a - 1 : a].isdigit():
            word = NEXT_WORD.match(text, k)
            number = WORD_BEFORE.search(text, max(begin, a - 6), a)
            if word and number and number.group().isdigit() and len(number.group()) <= 2 and word.group().lower() in MONTHS:
                return False
        return not THAI.match(nxt) or bool(THAI.match(text[a - 1 : a]))
    return True


def sentence_ends(text: str | None) -> list[int]:
    """Offsets, in characters, just behind the last character of each sentence."""
    if not text or not (full := len(text.rstrip())):
        return []
    out: list[int] = []
    thai, languages = bool(THAI.search(text)), Languages(text)
    start = 0
    gaps = [(m.start(), m.end()) for m in BLANK_LINE.finditer(text, 0, full)] if "\n" in text or "\r" in text or not text.isprintable() else []
    for gap, after in [*gaps, (full, full)]:
        while gap > start and text[gap - 1].isspace():
            gap -= 1
        if gap > start:
            _paragraph(text, start, gap, thai, out, languages)
            out.append(gap)
        start = max(start, after)
    return out


class Openers:
    """Opened quotations and brackets. Every mark is put in and taken out once, so a text takes linear time."""

    def __init__(self, text: str, stop: int) -> None:
        self.text, self.stop = text, stop
        self.marks: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.last: dict[str, int] = {}

    def open(self, mark: str, at: int) -> None:
        for c in CLOSED_BY[mark]:
            self.places.setdefault(c, []).append(len(self.marks))
        self.marks.append((mark, at))

    def closes(self, c: str) -> int:
        """Place of the innermost mark that c closes, or -1."""
        found = self.places.get(c)
        return found[-1] if found else -1

    def close(self, place: int) -> tuple[str, int]:
        """Takes out the mark at a place and all inside it."""
        while len(self.marks) > place:
            out = self.marks.pop()
            for c in CLOSED_BY[out[0]]:
                self.places[c].pop()
        return out

    def clear(self) -> None:
        self.marks.clear()
        self.places.clear()

    def pending(self, at: int) -> bool:
        """Whether one of the marks is closed later in the paragraph."""
        for c, found in self.places.items():
            if found and c in PAIR_CLOSERS:
                if c not in self.last:
                    self.last[c] = self.text.rfind(c, 0, self.stop)
                if self.last[c] >= at:
                    return True
        return False


def _paragraph(text: str, start: int, stop: int, thai: bool, out: list[int], languages: Languages) -> None:
    """Appends the ends inside text[start:stop]; not its last one."""
    events = [(m.start(), m.end(), m.group()) for m in EVENT.finditer(text, start, stop)]
    if thai and (first := THAI.search(text, start, stop)):
        events = sorted(events + [(m.start(), m.end(), " ") for m in THAI_SPACE.finditer(text, first.start(), stop)])
    begin = start
    while begin < stop and text[begin].isspace():
        begin += 1
    opened = Openers(text, stop)
    skip = start
    for a, b, mark in events:
        if a < skip:
            continue
        if mark == " ":
            if not opened.pending(b):
                out.append(a)
                begin, skip = b, b
                opened.clear()
            continue
        if mark in PAIRS or mark in CLOSERS:
            at = opened.closes(mark)
            if at >= 0:
                opened.close(at)
            elif mark in PAIRS:
                opened.open(mark, a)
            continue
        e, quote = b, -1
        while e < stop:
            c = text[e]
            step = 1
            if c in " \u00a0\u202f" and text[e + 1 : e + 2] in ("»", "›"):
                c, step = text[e + 1], 2
            if c in CLOSERS and (at := opened.closes(c)) >= 0:
                which, place = opened.close(at)
                if which not in BRACKETS:
                    quote = place
            elif c in "’'" and c not in PAIRS:
                pass
            elif quote >= 0 and (c in FULL_STOPS or EVENT.match(c) and c not in PAIRS and c not in CLOSERS):
                pass
            else:
                break
            e += step
        skip = e
        if e >= stop:
            return
        if not opened.pending(e) and _ends(text, mark, a, b, e, begin, stop, quote, languages, start):
            out.append(e)
            begin = e
            while begin < stop and text[begin].isspace():
                begin += 1
            opened.clear()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [sentence_ends(t) for t in batch.column("text").to_pylist()]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(ends, pa.list_(pa.int32()))],
            names=[*(batch.schema.names[i] for i in keep), "ends"],
        )


def sentences(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per sentence: keys, sentence_no (0-based), end_pos. No shuffle; texts with NULL or blank text give none.

    Only the keys and the offsets come back from Python, not the texts.
    """
    narrow = texts.select(*[F.col(k) for k in keys], F.col(text).alias("text")).where(F.col("text").isNotNull())
    schema = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes if n != "text") + ", ends array<int>"
    found = narrow.mapInArrow(_batches, schema)
    return found.select(*keys, F.posexplode("ends").alias("sentence_no", "end_pos"))


def request_texts(requests: DataFrame) -> DataFrame:
    """Entries of texts with their 0-based place; NULL arrays and NULL entries give no row."""
    return requests.select("request_id", "setting_id", F.posexplode("texts").alias("text_no", "text")).where(F.col("text").isNotNull())
