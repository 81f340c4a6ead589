"""One consistent form for text that looks the same.

A token's letters are resolved to the scripts they may belong to: a letter with a twin in another script counts for both. The
intersection over the token says which scripts could have written it alone. Mixed tokens, and whole tokens in the wrong
script, are respelled in the consistent one; other forms (full width, split accents, invisible characters, spaces, joined
letters, twins of signs) are normalised. Which letters are twins is stated for Cyrillic and Greek, and follows the Unicode
confusables data, as the JVM's ICU library has them, for the other alphabets. Other forms follow the Unicode decompositions.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that a reader can't tell from Latin ones; the first of several for a Latin letter is the usual one.
CYRILLIC_TWINS = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "Ӏ": "I", "ѵ": "v"}
GREEK_TWINS = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J"}
LATIN_TWINS = {"ɡ": "g"}
# Greek letters that stand for quantities and units of their own.
GREEK_SYMBOLS = frozenset("αβγδεζηθικλμνξπρςστυφχψωΓΔΘΛΞΠΣΦΨΩϕϑϵ")
#: Further alphabets, by the first word of their letters' names, whose letters may stand in for Latin ones.
ALPHABETS = frozenset("ARMENIAN CHEROKEE LISU COPTIC DESERET CANADIAN GEORGIAN TIFINAGH OSAGE WARANG LYCIAN CARIAN ELBASAN RUNIC OLD".split())
#: Characters that can't be seen. Joiners count as invisible, as none of the scripts handled here needs them.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
HYPHENS = {"\u2010": "-", "\u2011": "-", "\ufe63": "-", "\uff0d": "-", "\u02d7": "-"}
#: Other twins of signs: compatibility forms that look the same.
SIGNS = {"\u00b5": "\u03bc", "\u2126": "\u03a9", "\u212a": "K", "\u212b": "\u00c5", "\u2215": "/", "\u2044": "/", "\u2223": "|", "\u037e": ";", "\u0387": "\u00b7", "\u2024": ".", "\u2236": ":", "\u02bc": "'", "\u01c3": "!", "\u2206": "\u0394", "\u2211": "\u03a3", "\u220f": "\u03a0"}

#: What can't need any change: ASCII, letters of the Latin blocks in their single form, and common signs of their own.
PLAIN = "\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u00b4\\u00b6-\\u0131\\u0134-\\u01c2\\u01cd-\\u01f0\\u01f4-\\u0260\\u0262-\\u02af\\u2012-\\u2023\\u2025-\\u2027\\u2030-\\u2043\\u2190-\\u2205\\u2207-\\u220e\\u2500-\\u27bf"
_TOKEN = re.compile(r"\w+")
#: Tokens with a letter outside of the Latin blocks.
_FOREIGN = re.compile("\\w*[^\\W\x00-\u024f\u1e00-\u1eff]\\w*")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
#: A character with the accents and invisible characters behind it (half-width voice marks count as accents), or one that isn't plain.
_CLUSTER = re.compile(rf"(?s).[\u0300-\u036f\uff9e\uff9f{INVISIBLE}]+|[^{PLAIN}]")


@cache
def _name(ch: str) -> str:
    return unicodedata.name(ch, "?")


@cache
def own_script(ch: str) -> str:
    """The first word of a letter's name, which is its script; '' for other characters."""
    return _name(ch).split(" ")[0].capitalize() if ch.isalpha() else ""


@cache
def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """(forms, styled), read off the Unicode decompositions: width forms, joined letters and Roman numerals, which always
    have their plain form; letters in a mathematical style, which have it inside of words and are signs alone."""
    forms, styled = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.decomposition(c).split(" ")[0]
        if kind in ("<wide>", "<narrow>") or kind == "<compat>" and re.search("LIGATURE F|LIGATURE I?J|LIGATURE LONG S T|ROMAN NUMERAL|^LATIN .*LETTER (LJ|NJ|DZ|L WITH SMALL LETTER J|N WITH SMALL LETTER J|D WITH SMALL LETTER Z)|LIGATURE ST", _name(c)):
            plain = unicodedata.normalize("NFKC", c)
            if not plain.isspace():
                forms[c] = plain
        elif kind == "<font>" and c.isalpha():
            styled[c] = unicodedata.normalize("NFKC", c)
    return forms, styled


@dataclass(frozen=True)
class Twins:
    """latin: letter of another script -> the Latin letter it looks like. back: script -> Latin letter -> its usual twin there."""

    latin: dict[str, str]
    back: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def of(latin: dict[str, str]) -> Twins:
        back: dict[str, dict[str, str]] = {}
        for letter, twin in latin.items():
            if own_script(letter) != "Latin":
                back.setdefault(own_script(letter), {}).setdefault(twin, letter)
        return Twins(latin, back)

    def scripts(self, ch: str) -> frozenset[str]:
        """Scripts that could have written the letter; empty for signs and numerals (any script)."""
        own = own_script(ch)
        if not own:
            return frozenset()
        if own == "Latin":
            return frozenset(("Latin", *(s for s, letters in self.back.items() if ch in letters)))
        return frozenset((own, "Latin")) if ch in self.latin else frozenset((own,))

    def spell(self, token: str, foreign_around: Callable[[], bool]) -> str:
        """The token in its consistent script.

        Mixed tokens with a Latin solution become Latin, a symbol of its own (μ of μs, Δ of Δf) excepted. A token wholly of twins
        becomes Latin if it has two letters or more and stands among Latin words; next to words truly of its script it stays.
        Latin letters inside a word of another script get that script's usual twins.
        """
        letters = [c for c in token if c.isalpha()]
        own = {own_script(c) for c in letters}
        if own <= {"Latin"}:
            return "".join(self.latin.get(c, c) for c in token)
        symbols = any(c in GREEK_SYMBOLS for c in letters)
        rest = [c for c in letters if c not in GREEK_SYMBOLS or c in self.latin and own_script(c) != "Greek"] if symbols else letters
        possible = None
        for c in rest or letters:
            possible = self.scripts(c) if possible is None else possible & self.scripts(c)
        to_latin = lambda: "".join(self.latin.get(c, c) for c in token)
        if "Latin" in possible:
            if len(own) == 1:
                return to_latin() if len(letters) > 1 and not foreign_around() else token
            return to_latin() if any(c in self.latin for c in letters) else token
        if len(possible) == 1:
            back = self.back.get(next(iter(possible)), {})
            return "".join(back.get(c, c) if own_script(c) == "Latin" else c for c in token)
        # no single script fits: respell the twins beside Latin letters, leave letters without a twin as they are
        return to_latin() if "Latin" in own else token

    def _respell(self, text: str) -> str:
        """The text with each token in its consistent script; of the same length."""
        if text.isascii():
            return text
        styled = _compatible()[1]
        parts, lo, spans = [], 0, None
        plain_style = lambda w: "".join(styled.get(c, c) for c in w) if sum(map(str.isalpha, w)) > 1 else w

        def foreign(w: str) -> bool:
            w = plain_style(w)
            return any(own_script(c) not in ("", "Latin") and c not in self.latin and c not in GREEK_SYMBOLS for c in w) and not any(own_script(c) == "Latin" for c in w)

        for m in _FOREIGN.finditer(text):
            w, at = plain_style(m.group()), m.start()

            def around(at: int = at) -> bool:
                """Whether one of the three tokens on either side is truly of another script."""
                nonlocal spans
                if spans is None:
                    spans = [x.span() for x in _TOKEN.finditer(text)]
                i = bisect_left(spans, (at, 0))
                return any(foreign(text[a:b]) for a, b in spans[max(0, i - 3) : i + 4])

            parts += [text[lo:at], w if w.isascii() else self.spell(w, around)]
            lo = m.end()
        return "".join(parts) + text[lo:]

    def form(self, text: str | None) -> str | None:
        """The one form of a text; null stays null. Line breaks and visibly different signs stay as they are."""
        if not text or text.isascii():
            return text
        out = _plain_forms(_SPACE.sub(" ", _INVISIBLE.sub("", text)))
        return unicodedata.normalize("NFC", self._respell(out))

    def aligned(self, text: str) -> tuple[str, list[int]]:
        """(form, places): the form, and for each of its characters the place in the text that it comes from."""
        out: list[str] = []
        places: list[int] = []
        at = 0
        for m in _CLUSTER.finditer(text):  # what lies between is plain
            part = _plain_forms(_SPACE.sub(" ", _INVISIBLE.sub("", m.group())))
            out += [text[at : m.start()], part]
            places.extend(range(at, m.start()))
            places.extend([m.start()] * len(part))
            at = m.end()
        out.append(text[at:])
        places.extend(range(at, len(text)))
        return self._respell("".join(out)), places


def _plain_forms(text: str) -> str:
    """Width forms, joined letters, hyphens and signs in their plain form, accents composed."""
    if text.isascii():
        return text
    forms = _compatible()[0]
    return unicodedata.normalize("NFC", "".join(c if c < "\x80" else HYPHENS.get(c) or SIGNS.get(c) or forms.get(c) or c for c in text))


def without_invisible(text: str) -> str:
    return _INVISIBLE.sub("", text)


def seen_places(text: str) -> tuple[str, list[int]]:
    """(text, places): the text without invisible characters, and for each character that is left its place."""
    places = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
    return "".join(text[i] for i in places), places


BASE = Twins.of(CYRILLIC_TWINS | GREEK_TWINS | LATIN_TWINS)


def plain_letter(ch: str) -> str:
    """The Latin letter that the letter looks like, or itself."""
    return BASE.latin.get(ch, ch)


_of_unicode: dict[str, Twins] = {}


def unicode_twins(spark: SparkSession) -> Twins:
    """The stated twins and those of the alphabets in ALPHABETS by the Unicode confusables data.

    A letter's twin is the Latin letter of the same case (of any, where scripts have none) with the same skeleton. The table is built
    once, in the driver, and has some hundred entries.
    """
    if "all" in _of_unicode:
        return _of_unicode["all"]
    wanted = [c for c in map(chr, range(0x80, 0x20000)) if c.isalpha() and _name(c).split(" ")[0] in ALPHABETS]
    latin = [c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)])]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(latin + wanted)).split("\n")  # line ends are their own skeleton
    by: dict[str, list[str]] = {}
    for c, s in zip(latin, skeletons):
        by.setdefault(s, []).append(c)
    more = {}
    for c, s in zip(wanted, skeletons[len(latin) :]):
        same = [x for x in by.get(s, ()) if x.isupper() == c.isupper() or not c.isupper() and not c.islower()]
        if same:
            more[c] = same[0]
    twins = _of_unicode["all"] = Twins.of(BASE.latin | more)
    return twins


def consistent_form(text: str | None) -> str | None:
    """The one form of a text by the stated twins."""
    return BASE.form(text)


def canonicalize(frame: DataFrame, text_col: str, out_col: str = "form") -> DataFrame:
    """Add ``out_col``, the consistent form of ``text_col``.

    Texts of plain characters only are their own form, which the JVM sees by one pattern; just the others go through Python.
    Null stays null, empty stays empty.
    """
    twins = unicode_twins(frame.sparkSession)

    def run(forms: pa.Array) -> pa.Array:
        return pa.array([twins.form(t) for t in forms.to_pylist()], pa.string())

    form = F.arrow_udf(run, "string")
    return frame.withColumn(out_col, F.when(F.col(text_col).rlike(f"[^{PLAIN}]"), form(F.when(F.col(text_col).rlike(f"[^{PLAIN}]"), F.col(text_col)))).otherwise(F.col(text_col)))


def changed_rows(frame: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key) of the rows whose text isn't in its consistent form; redelivered rows count once, null keys give none."""
    odd = frame.select(F.col(key_col).cast("bigint").alias("key"), F.col(text_col).alias("text")).where(F.col("key").isNotNull() & F.col("text").rlike(f"[^{PLAIN}]"))
    twins = unicode_twins(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [k for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if twins.form(t) != t]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    return odd.mapInArrow(run, "key bigint").distinct()
