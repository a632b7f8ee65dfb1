"""Problem 8: template residue and error-page text.

Trusted labels are few. Two rules read syntax only: unfilled slots or traces of values that failed to print in running
text ('slot'), and bare null values of programs ('null'). All other labels come from the trusted messages, a table of
known notices and filler sentences (TRUSTED, a parameter), by near-duplicates.

Units. A text without tags, statements and frame lines is cut into its lines and sentences. A unit's skeleton is its
words in lower case with numbers as 0, words that no trusted message holds as one placeholder, filler Latin and
keyboard filler as one symbol, and a repeated phrase once; its five-word shingles are what is compared. A document is represented by its
longest unit if that is long (more than LONG words): if it is no residue, the document has content. A document of short
units only is represented by all of them. So a corpus text costs one short set of shingles.

Spread. Units are reduced to one per skeleton. Partitioned SimHash tables (every pair of blocks of 64 bits is a
table) meet labelled and unlabelled skeletons; Hamming distance and shingle similarity (0.8) decide; labels walk along
the links, round by round, through the components that hold a trusted label. SimHashes lose links near 0.8, so when the
tables find nothing more, an exact prefix filter looks for what they missed: sets that share 0.8 of all their shingles
share two of the first n - ceil(0.8 n) + 2 of each in one fixed order. What it finds goes through the tables again.
Only links between labelled and unlabelled skeletons are formed, so a bucket of equal notices costs no pairs.

Pages. A document is residue if one of its units is labelled and none of its long units is unlabelled, whatever frame
is around them. Slot labels do not spread: a near-duplicate may have the slot filled in.

Defined cases: NULL and blank texts and rows without doc_id carry no label; texts are read whole; exact copies share
their label; repeated rows of one doc_id count each by its own text; an empty table gives no row.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Words of a unit from which on it is content unless it is labelled; three signs of a script without spaces are a word.
LONG = 7
#: Blocks of a SimHash by the number of units under a power of two; every pair of blocks is a table. More units take
#: fewer, wider blocks, so that a bucket holds a few tens of units; what wider blocks miss, the prefix filter finds.
BLOCKS = ((20, 8), (24, 7), (64, 6))
#: Bits in which linked units differ at most; sets of similarity 0.8 differ in 9.7 on average, with a deviation of 2.9.
MAX_BITS = 18
#: Looked-up shingles that a candidate pair of the prefix filter must share; sets of one shingle share that one.
SHARED = 2
#: Logarithm by which the sizes of linked sets differ at most.
SIZE_STEP = -math.log(SIMILARITY) + 1e-9
#: Most looked-up rows of labelled units that are broadcast: some 10 MB.
BROADCAST_ROWS = 200_000

# Forms of unfilled slots.
NAME = r"[^\W\d][\w.\-]{0,39}"
SLOT = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*[#/^&]?\s*{NAME}(?:\s{NAME}){{0,3}}\s*\}}?\}}\}}",
            rf"[$#]\{{\s*{NAME}\s*\}}",
            rf"(?<![A-Za-z0-9_$#{{\\])\{{(?:{NAME}|\d{{1,2}})\}}(?!\}})",
            rf"%\({NAME}\)[sdifr]",
            r"(?<![A-Za-z0-9%])%[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*%(?![A-Za-z0-9%])",
            rf"@@{NAME}@@",
            r"(?<![A-Za-z0-9_])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![A-Za-z0-9_])",
            rf"<<\s*{NAME}(?:\s{NAME}){{0,3}}\s*>>",
            rf"<%[=-]?\s*{NAME}(?:\s{NAME}){{0,3}}\s*-?%>",
            r"(?i:<[a-z][a-z_\s]{0,40}\bhere>)",
            r"(?i:\[(?:your|insert|enter|add|type|put|choose|select|completar|insertar|introducir|rellenar|compléter|insérer|вставить|введите|укажите)\s[^\]\[]{1,40}\])",
            r"(?i:\[[^\]\[]{1,40}\s(?:here|to be (?:supplied|added|filled|completed|inserted)|einfügen|eintragen|à compléter|à insérer|aquí)\])",
            r"【[^】\n]{0,12}(?:填写|输入|入力|記入|插入)[^】\n]{0,12}】",
            r"(?<![\w_])_{5,}(?![\w_])",
        )
    )
)
# What is printed where a value failed to print.
TRACE = re.compile(r"(?i:\[object\s+object\])|(?<![A-Za-z0-9_.$-])(?:undefined|UNDEFINED|NaN|null)(?![A-Za-z0-9_(=-]|\.[A-Za-z0-9_])|#(?:REF!|N/A|VALUE!|NAME\?|DIV/0!)")
#: What every slot or trace holds.
HINT = re.compile(r"[{<%【\[]|@@|__|#[RNVD]|undefined|UNDEFINED|NaN|null")
STATEMENT = re.compile(r"^\s*[>*\-]?\s*\(:\s.*$", re.M)
FENCE = re.compile(r"```.*?```|~~~.*?~~~|<(code|pre)\b[^>]*>.*?</\1>", re.S | re.I)
OPEN_QUOTES, CLOSE_QUOTES = "\"'“„«‘「『`‹", "\"'”“»’」』`›"
# Null values of programs.
NULLS = re.compile(r"(?:\s*(?:null|nul|none|nil|n/a|undefined|void|nullptr|\(null\)|<null>|<none>|\[object object\]|#ref!|#n/a|#value!|#name\?|#div/0!|(?:na)+n)[\s,;.|]*)+", re.I)

# Words of keyboard filler and of filler Latin.
KEY_WORDS = frozenset("asdf asdfg asdfgh qwer qwert qwerty zxcv zxcvb jkl hjkl foo bar baz qux quux test testing tests blah bla xxx yyy zzz abc".split())
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore "
    "et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque "
    "habitant morbi tristique senectus netus malesuada fames ac turpis egestas vitae ornare quisque porta mollis lacus "
    "sapien varius cursus tortor magnis vel feugiat ametum dolorem sitar nunc donec maecenas curabitur phasellus aenean "
    "integer praesent vivamus fusce suspendisse nam cras proin etiam aliquam mauris nibh risus justo massa urna leo at "
    "mattis ante erat odio augue pede ligula eget neque felis arcu orci purus metus diam sem tellus lectus vulputate".split()
)

# The trusted messages, one unit a line; * stands for a value.
TRUSTED_NOTICES = """
404 Not Found
403 Forbidden
401 Unauthorized
400 Bad Request
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
502 Bad Gateway: upstream gave no reply
503 Service Unavailable
504 Gateway Timeout
Error 404
Error 404: page not found
Page not found
The requested page could not be found
The requested entry * could not be located on this server
The requested URL * was not found on this server
The page you were looking for has moved or never existed
The page you are looking for does not exist
This entry has been removed or is no longer available: *
This page is no longer available
This account has been suspended
Error 500: the * is temporarily unavailable
Error 503: the knowledge store is temporarily unavailable
The service is temporarily unavailable
Please try again later
Please try again in 5 minutes
Something went wrong
Something went wrong while loading this page
An error occurred while processing your request
Internal server error
Access denied
Permission denied
You do not have permission to view *
You do not have permission to access this page
You are not authorized to view this page
Your session has expired
Your session has timed out
Please sign in to continue
Sign in again to continue to *
Too many requests from this address
Rate limit exceeded
Please enable JavaScript to view this page
Please enable JavaScript and cookies to continue
You need to enable JavaScript to run this app
JavaScript is disabled in your browser
JavaScript is required to view this page
This site needs scripts to run
This site requires JavaScript
Turn on JavaScript in your browser settings and reload
You need to allow cookies and scripts before * can be shown
Cookies must be enabled
Scripts must be on
noscript: the viewer * does not work without client scripting
if nothing happens, your browser may be blocking scripts
Checking that you are human
Checking your browser before accessing *
Verify that you are human
Please verify you are not a robot
Complete the CAPTCHA to continue
{"status": 500, "message": "internal failure", "trace": "*"}
{"error": "not found"}
Traceback (most recent call last)
File "*", line 5, in *
TimeoutError: * did not answer
Fehler 404
Seite nicht gefunden
Seite nicht gefunden (Fehler 404)
Der Eintrag * existiert nicht mehr
Diese Seite ist nicht verfügbar
Zugriff verweigert
Bitte aktivieren Sie JavaScript, um * anzuzeigen
Erreur 404
Erreur 500 : le serveur * a rencontré un problème interne
Page introuvable
Cette page n'existe plus
Accès refusé
Veuillez activer JavaScript pour afficher *
Página no encontrada
Vuelva al inicio o busque *
La página no existe
Acceso denegado
Active JavaScript en su navegador para ver *
Страница не найдена
Ошибка 404
Страница * не найдена
Доступ запрещён
Для просмотра * включите JavaScript
Включите JavaScript
页面不存在
页面未找到
页面不存在（错误 404）：*
拒绝访问
请启用 JavaScript 后再查看 *
请启用 JavaScript
ページが見つかりません
お探しのページ * は見つかりませんでした
アクセスが拒否されました
* を表示するには JavaScript を有効にしてください
الصفحة غير موجودة
يرجى تفعيل JavaScript لعرض *
पृष्ठ नहीं मिला
कृपया JavaScript सक्षम करें
ไม่พบหน้าที่คุณต้องการ
กรุณาเปิดใช้งาน JavaScript เพื่อดู *
"""
TRUSTED_FILLER = """
Your text here
Insert text here
Sample text
Sample text goes here
Placeholder text
Placeholder
Add a description of this entry
Content coming soon
Coming soon
Content goes here
Description to follow
To be written
To be added
To be announced
To be determined
TBD
TODO
Under construction
test
asdf
qwerty
foo
blah
Lorem ipsum dolor sit amet consectetur
Texte à venir
Contenu à venir
Bientôt disponible
Texto de ejemplo
Texto de relleno
Próximamente
Platzhalter
Platzhaltertext
Blindtext
Beispieltext
Text folgt
Пример текста
Здесь будет текст
这里是示例文字
此处输入文字
敬请期待
ここにテキストが入ります
サンプルテキスト
準備中
نص تجريبي
هنا يوضع النص
नमूना पाठ
यहाँ पाठ लिखें
ข้อความตัวอย่าง
"""
TRUSTED = tuple((label, line) for label, block in (("notice", TRUSTED_NOTICES), ("filler", TRUSTED_FILLER)) for line in block.strip().splitlines())

# Lines of a page's frame.
FRAME = re.compile(
    r"(?:[^|]{1,24}\|){1,}[^|]{0,24}$|©|copyright\b|all rights reserved|(?:go )?(?:back|return) to\b|contact (?:the|us)\b|(?:home|menu|login|search|about|archive|entries|imprint|privacy|terms)\W*$"
    r"|zurück zur?\b|retour à\b|(?:vuelva|volver) al?\b|вернуться\b|вернитесь\b|返回|トップに戻る|wait \d+|reference \S+\W*$|request ref\b"
)
PARTS = re.compile(r"(?<=[.!?])\s+|[\n\r]+|(?<=[。！？])")
#: Line breaks inside a sentence.
WRAP = re.compile(r"(?<=[^\s.!?:。！？])[ \t]*\r?\n(?=[^\W\d_])(?=\S*[a-zß-ÿа-я])(?![A-ZÀ-ÞА-Я])")
TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>\n]{0,80})?/?>", re.I)
WIDE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
WORD = re.compile(r"[^\W_]+")
NUMBER = re.compile(r"\d+")
VALUE, LATIN = "*", "§"


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is only quoted or shown as code."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if before and after and before in OPEN_QUOTES and after in CLOSE_QUOTES:
        return True
    start = max(text.rfind("\n", 0, a) + 1, a - 160)
    end = text.find("\n", b)
    end = min(len(text) if end < 0 else end, b + 160)
    for o, c in (("`", "`"), ('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("「", "」")):
        if o == c:
            inside = text.count(o, text.rfind("\n", 0, a) + 1, a) % 2 == 1 and text.find(c, b, end) >= 0
        else:
            i = text.rfind(o, start, a)
            inside = i >= 0 and text.find(c, i + 1, a) < 0 and text.find(c, b, end) >= 0
        if inside:
            return True
    return False


def has_slot(text: str) -> bool:
    """Whether running text holds an unfilled slot or the trace of a value that failed to print."""
    if not HINT.search(text) or not (SLOT.search(text) or TRACE.search(text)):
        return False
    text = FENCE.sub(" ", STATEMENT.sub(" ", text))
    return any(not _quoted(text, *m.span()) for p in (SLOT, TRACE) for m in p.finditer(text))


def rule_label(text: str) -> str | None:
    """The trusted label that syntax alone gives: 'null' or 'slot'."""
    bare = TAG.sub(" ", text).strip()
    if bare and NULLS.fullmatch(bare):
        return "null"
    return "slot" if has_slot(text) else None


def page_units(text: str) -> list[str]:
    """Lines and sentences of the text in lower case, without tags, statements and frame."""
    text = WRAP.sub(" ", TAG.sub(" ", STATEMENT.sub("\n", text))).lower()
    return [s for part in PARTS.split(text) if (s := part.strip().lstrip("#>*-•– \t")) and not FRAME.match(s)]


def _weight(unit: str) -> float:
    return len(WORD.findall(unit)) + len(WIDE.findall(unit)) / 3


class Skeletons:
    """Skeletons of units under a set of trusted messages, and their shingles as 64-bit hashes."""

    _MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

    def __init__(self, trusted: Sequence[tuple[str, str]]) -> None:
        words = {w for _, message in trusted for w in self._words(message)} | {VALUE, LATIN}
        self.known = {w: xxhash.xxh3_64_intdigest(w) for w in words}

    @staticmethod
    def _words(unit: str) -> list[str]:
        return [NUMBER.sub("0", w) for w in re.findall(r"[^\W_]+|\*", unicodedata.normalize("NFC", unit.lower()))]

    def words(self, unit: str) -> list[str]:
        """The skeleton; empty if no word of the unit is in a trusted message."""
        found = self._words(unit)
        plain = [w for w in found if w != VALUE]
        if len(plain) > 1 and (sum(w in FILLER_WORDS for w in plain) >= 0.8 * len(plain) or all(w in KEY_WORDS for w in plain)):
            return [LATIN]
        out: list[str] = []
        for w in found:
            if w not in self.known:
                w = VALUE
            if w != VALUE or out[-1:] != [VALUE]:
                out.append(w)
        if not any(w not in (VALUE, "0") for w in out):
            return []
        return out[: _period(out)]

    def shingles(self, words: list[str]) -> np.ndarray:
        h = np.fromiter((self.known[w] for w in words), np.uint64, len(words))
        if len(h) < SHINGLE_WORDS:
            h = np.concatenate((h, np.zeros(SHINGLE_WORDS - len(h), np.uint64)))
        n = len(h) - SHINGLE_WORDS + 1
        s = np.zeros(n, np.uint64)
        for i in range(SHINGLE_WORDS):
            s = (s ^ (h[i : i + n] * self._MULTIPLIERS[i])) * np.uint64(0xFF51AFD7ED558CCD)
            s ^= s >> np.uint64(29)
        return np.sort(np.unique(s).view(np.int64))

    def row(self, unit: str) -> dict | None:
        """key, SimHash and shingles of a unit; None without a skeleton."""
        words = self.words(unit)
        if not words:
            return None
        s = self.shingles(words)
        return {"unit": xxhash.xxh3_128_digest(s.tobytes()), "sim": simhash(s), "shingles": s.tolist()}


def _period(words: list[str]) -> int:
    """Length of the shortest phrase whose repetition the words are."""
    fail = [0] * len(words)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k - 1]
        k += words[i] == words[k]
        fail[i] = k
    shift = len(words) - (fail[-1] if fail else 0)
    return shift if shift and len(words) % shift == 0 else len(words)


def simhash(shingles: np.ndarray) -> int:
    """64 majority bits as a signed integer."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(shingles), bitorder="little").view(np.int64)[0])


UNIT = pa.struct([("unit", pa.binary()), ("sim", pa.int64()), ("shingles", pa.list_(pa.int64()))])
UNIT_DDL = "unit: binary, sim: bigint, shingles: array<bigint>"
FEATURES = f"doc_id long, label string, long boolean, units array<struct<{UNIT_DDL}>>"


def _features(trusted: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeletons = Skeletons(trusted)
        for batch in batches:
            ids, labels, longs, units = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                label = rule_label(text)
                found, long = [], False
                if label is None:
                    parts = page_units(text)
                    first = max(parts, key=len, default="")
                    if not (long := _weight(first) > LONG):
                        others = [p for p in parts if _weight(p) > LONG]
                        first, long = (others[0], True) if others else (first, False)
                    found = [first] if long else list(dict.fromkeys(parts))
                    found = [r for p in found if (r := skeletons.row(p))]
                    if not found:
                        continue
                ids.append(doc_id)
                labels.append(label)
                longs.append(long)
                units.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(longs, pa.bool_()), pa.array(units, pa.list_(UNIT))], names=["doc_id", "label", "long", "units"])

    return run


def _long_units(trusted: Sequence[tuple[str, str]]):
    """All long units of each text; one without a skeleton has a NULL key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeletons = Skeletons(trusted)
        blank = {"unit": None, "sim": None, "shingles": None}
        for batch in batches:
            units = [[skeletons.row(p) or blank for p in dict.fromkeys(page_units(t)) if _weight(p) > LONG] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(UNIT))], names=["doc_id", "units"])

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))


def features(documents: DataFrame, trusted: Sequence[tuple[str, str]] = TRUSTED) -> DataFrame:
    """doc_id, label by rules or NULL, and the units that represent it; one pass over the texts, no shuffle. Documents
    that share no word with a trusted message and have no label give no row."""
    return _texts(documents).mapInArrow(_features(tuple(trusted)), FEATURES)


def _reps(units: DataFrame) -> DataFrame:
    """One row per skeleton."""
    return units.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.any_value("sim").alias("sim"), F.any_value("shingles").alias("shingles"))


def blocks(units: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block of a SimHash."""
    n = next(k for bits, k in BLOCKS if units < 1 << bits)
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _in_tables(reps: DataFrame, name: str, cut: list[tuple[int, int]]) -> DataFrame:
    """A row for each table: its number and the bits of its two blocks."""
    block = [F.shiftrightunsigned("sim", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in cut]
    pairs = itertools.combinations(range(len(cut)), 2)
    rows = F.array(*[F.struct(F.lit(k).alias("table"), (F.shiftleft(block[i], 16) + block[j]).cast("int").alias("bits")) for k, (i, j) in enumerate(pairs)])
    return reps.select(F.col("unit").alias(name), F.col("sim").alias(f"{name}_sim"), F.inline(rows))


def _by_tables(frontier: DataFrame, rest: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    """Pairs (l, u) that meet in a SimHash table and differ in few bits."""
    labelled = _in_tables(frontier, "l", cut)
    if frontier.count() * math.comb(len(cut), 2) <= BROADCAST_ROWS:
        labelled = F.broadcast(labelled)
    near = F.bit_count(F.col("l_sim").bitwiseXOR(F.col("u_sim"))) <= MAX_BITS
    return _in_tables(rest, "u", cut).join(labelled, ["table", "bits"]).where(near).select("l", "u").distinct()


def _looked_up(reps: DataFrame, name: str, around: int) -> DataFrame:
    """A row for each shingle that is looked up and each step of size up to `around` from that of its set."""
    n = F.size("shingles")
    least = F.ceil(SIMILARITY * n - 1e-9).cast("int")
    look = F.slice("shingles", F.lit(1), n - least + F.least(F.lit(SHARED), least))
    step = F.floor(F.log(n.cast("double")) / SIZE_STEP).cast("int")
    steps = F.array(*[step + i for i in range(-around, around + 1)])
    rows = reps.select(F.col("unit").alias(name), n.alias(f"{name}_size"), look.alias("look"), F.explode(steps).alias("step"))
    return rows.select(name, f"{name}_size", "step", F.explode("look").alias("token"))


def _by_prefix(frontier: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs (l, u) that may be similar enough; all that are, are among them."""
    labelled = _looked_up(frontier, "l", 1)
    if frontier.agg(F.coalesce(F.sum(3 * F.size("shingles")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        labelled = F.broadcast(labelled)
    small, large = F.least("l_size", "u_size"), F.greatest("l_size", "u_size")
    met = _looked_up(rest, "u", 0).join(labelled, ["token", "step"]).where(small >= SIMILARITY * large - 1e-9)
    counted = met.groupBy("l", "u").agg(F.count(F.lit(1)).alias("shared"), F.min(small).alias("n"))
    return counted.where(F.col("shared") >= F.least(F.lit(SHARED), F.col("n"))).select("l", "u")


def _linked(pairs: DataFrame, frontier: DataFrame, rest: DataFrame, found_by: str) -> DataFrame:
    """The unlabelled units of pairs whose shingles are similar, with their label: the new frontier."""
    a = frontier.select(F.col("unit").alias("l"), F.col("shingles").alias("ls"), "label")
    b = rest.select(F.col("unit").alias("u"), "sim", "shingles")
    common = F.size(F.array_intersect("ls", "shingles"))
    alike = common >= SIMILARITY * (F.size("ls") + F.size("shingles") - common) - 1e-9
    linked = pairs.join(a, "l").join(b, "u").where(alike)
    rows = linked.groupBy(F.col("u").alias("unit")).agg(F.any_value("sim").alias("sim"), F.any_value("shingles").alias("shingles"), F.min("label").alias("label"))
    return materialize(rows.withColumn("found_by", F.lit(found_by)), "residue-linked")


def spread(labelled: DataFrame, units: DataFrame, exact: bool = True) -> DataFrame:
    """unit, sim, shingles, label and found_by ('tables' or 'prefix') of all units in a component with a labelled one.

    labelled: unit, sim, shingles, label. units: unit, sim, shingles, one row each; both written tables. The tables run
    until they find nothing more, then the prefix filter from all labelled units, until that finds nothing either.
    """
    none = labelled.limit(0).withColumn("found_by", F.lit("tables"))
    found, frontier, rest, every = none, labelled, units, labelled
    by_tables, cut = True, blocks(units.count())
    while True:
        pairs = _by_tables(frontier, rest, cut) if by_tables else _by_prefix(every, rest)
        new = _linked(pairs, frontier if by_tables else every, rest, "tables" if by_tables else "prefix")
        if new.isEmpty():
            if not by_tables or not exact:
                return found
            by_tables = False
            continue
        found, every, frontier, by_tables = found.unionByName(new), every.unionByName(new.drop("found_by")), new.drop("found_by"), True
        rest = rest.join(new.select("unit"), "unit", "left_anti")


def trusted_units(documents: DataFrame, trusted: Sequence[tuple[str, str]] = TRUSTED) -> DataFrame:
    """The trusted messages as labelled units: a table as small as its parameter."""
    skeletons = Skeletons(trusted)
    rows = {r["unit"]: (r["unit"], r["sim"], r["shingles"], label) for label, message in trusted if (r := skeletons.row(message))}
    return documents.sparkSession.createDataFrame(list(rows.values()), "unit binary, sim long, shingles array<long>, label string")


def residue(documents: DataFrame, trusted: Sequence[tuple[str, str]] = TRUSTED) -> DataFrame:
    """doc_id, label ('slot', 'null', 'notice', 'filler') and found_by ('rule', 'tables', 'prefix') of each residue document.

    Texts are read once; those of documents represented by a labelled long unit once more for their other long units.
    """
    seen = materialize(features(documents, trusted), "residue-features")
    seeds = trusted_units(documents, trusted)
    units = materialize(_reps(seen.select(F.inline("units"))), "residue-units")
    labels = materialize(spread(seeds, units), "residue-labels")
    of_unit = labels.select("unit", "label", "found_by")
    pages = seen.where(F.col("label").isNull()).select("doc_id", "long", F.inline("units")).join(of_unit, "unit")
    pages = pages.groupBy("doc_id").agg(F.max("long").alias("long"), F.min(F.struct("label", "found_by")).alias("l"))
    pages = materialize(pages.select("doc_id", "long", "l.label", "l.found_by"), "residue-pages")
    texts = _texts(documents).join(pages.where("long").select("doc_id"), "doc_id", "left_semi")
    longs = materialize(texts.mapInArrow(_long_units(tuple(trusted)), f"doc_id long, units array<struct<{UNIT_DDL}>>").select("doc_id", F.inline("units")), "residue-longs")
    unknown = materialize(_reps(longs).join(of_unit.select("unit"), "unit", "left_anti"), "residue-unknown")
    if not unknown.isEmpty():
        more = spread(seeds.unionByName(labels.drop("found_by")), unknown)
        of_unit = of_unit.unionByName(more.select("unit", "label", "found_by"))
    content = longs.join(of_unit.select("unit"), "unit", "left_anti").select("doc_id").distinct()
    by_rule = seen.where(F.col("label").isNotNull()).select("doc_id", "label", F.lit("rule").alias("found_by"))
    return by_rule.unionByName(pages.join(content, "doc_id", "left_anti").select("doc_id", "label", "found_by"))


def without_residue(documents: DataFrame) -> DataFrame:
    return documents.join(residue(documents).select("doc_id").distinct(), "doc_id", "left_anti")
