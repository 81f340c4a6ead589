"""Text rules of documents as Column functions, with the Unicode meaning of white space and digits."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class body (all Unicode white space and the separators U+001C to U+001F).
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Titles of front matter that open a section without a number.
NAMED_SECTIONS = ("introduction", "contents", "list of figures", "list of tables", "foreword", "modal verbs terminology", "executive summary", "change history", "revision history", "history")
# Front matter that the specification profile removes.
REMOVABLE_SECTIONS = ("contents", "list of figures", "list of tables", "foreword", "modal verbs terminology", "change history", "revision history", "history")
# Titles that say nothing about a document.
GENERIC_TITLES = ("introduction", "preamble", "scope", "contents", "foreword", "references", "abstract", "executive summary", "modal verbs terminology")
# Fixed value: lines of a cover page that are no title.
BOILERPLATE = r"copyright|all rights reserved|vat\s*id|register of associations|confidential|do not distribute|©"
# Characters of paragraphs that are only a rule.
NOISE_CHARS = "_—\\- \\xa0"
# Fixed value: file stems of specifications (group, body, release, version).
DOCUMENT_ID = r"(?i)^O-RAN\.(WG\d+|[A-Za-z]+FG)((?:\.[A-Za-z0-9]+(?:-(?!R\d+-v)[A-Za-z0-9]+)*)+)(?:-R(\d+))?-v(\d{2}\.\d{2})$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_WS_CHARS))


def first_line(c: Column) -> Column:
    """The stripped first line of the stripped text."""
    return strip(F.substring_index(strip(c), "\n", 1))


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, f"[{WS}]+", " ")


def normalize_text(c: Column) -> Column:
    """Lower case, digits removed, white space collapsed and stripped. Null stays null."""
    return strip(collapse(F.regexp_replace(F.lower(c), r"\p{Nd}+", "")))


def normalize_section_title(c: Column) -> Column:
    """First line without dot leaders and the page number behind them, collapsed, lower case."""
    line = F.regexp_replace(first_line(c), rf"[.…·{WS}_\-]+\p{{Nd}}*[{WS}]*$", "")
    return strip(F.lower(collapse(line)))


def named(c: Column, names: Iterable[str]) -> Column:
    """Whether the normalised title is one of the names, or one followed by a slash."""
    return c.rlike(rf"^(?:{'|'.join(map(re.escape, names))})(?:/|\z)")


def is_removable_section(c: Column, names: Iterable[str] = REMOVABLE_SECTIONS) -> Column:
    return F.coalesce(named(normalize_section_title(c), names), F.lit(False))


def is_generic_title(c: Column, names: Iterable[str] = GENERIC_TITLES) -> Column:
    return F.lower(strip(c)).isin(*names)


def is_boilerplate(c: Column, pattern: str = BOILERPLATE) -> Column:
    """Whether the pattern occurs, in any case; an empty pattern never does."""
    return c.rlike(f"(?iu)(?:{pattern})") if pattern else F.lit(False)


def is_noise(c: Column, chars: str = NOISE_CHARS) -> Column:
    """Not blank and made of the given characters only."""
    return strip(c).rlike(f"^[{chars}]+$") & (F.length(strip(c)) > 0) if chars else F.lit(False)


def heading_level(c: Column) -> Column:
    """Level of a numbered (1.2 Title), annex (A.1 Title) or named heading by its first line; null for other texts."""
    line = first_line(c)
    rest = rf"[{WS}]+[^{WS}].+$"
    number = F.regexp_extract(line, rf"^(\p{{Nd}}+(?:\.\p{{Nd}}+)*){rest}", 1)
    annex = F.regexp_extract(line, rf"^([A-Z](?:\.\p{{Nd}}+)+){rest}", 1)
    dots = lambda n: F.length(n) - F.length(F.replace(n, F.lit("."))) + 1
    return F.when(named(strip(F.lower(collapse(line))), NAMED_SECTIONS), 1).when(number != "", dots(number)).when(annex != "", dots(annex))


def is_figure_caption(c: Column) -> Column:
    """Figure / Fig. / Figura with a number, or an annex number."""
    return first_line(c).rlike(rf"(?i)^(?:figure|fig\.|figura)[{WS}]+(?:[A-Za-z](?:\.\p{{Nd}}+)+|\p{{Nd}})")


def is_table_caption(c: Column) -> Column:
    """Table with a number."""
    return strip(c).rlike(rf"(?i)^table[{WS}]+[\p{{Nd}}.]+-?\p{{Nd}}*")


def is_retained_heading(c: Column) -> Column:
    """An unnumbered heading that stays one: annex titles and additional information."""
    line = strip(F.lower(collapse(first_line(c))))
    return (line != "") & ~is_figure_caption(line) & ((line == "additional information") | line.startswith("annex"))


def is_list_marker(c: Column) -> Column:
    """A marker such as 1) before text."""
    return first_line(c).rlike(rf"^\p{{Nd}}+\)[{WS}]*[^{WS}]")


def is_list_label(c: Column) -> Column:
    """Parent of a sub-list: a marker, or a short first line that ends with a colon."""
    line = first_line(c)
    colon = line.endswith(":") & (F.length(line) >= 2) & (F.length(line) - F.length(F.replace(line, F.lit(" "))) <= 12)
    return F.coalesce((line != "") & (F.length(line) <= 100) & (is_list_marker(line) | colon), F.lit(False))


def slug(c: Column) -> Column:
    """Lower case, other runs than a-z0-9 as one hyphen, stripped of them, cut to 48; 'section' if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.when(F.coalesce(s, F.lit("")) == "", "section").otherwise(s)


def section_id(n: Column, title: Column) -> Column:
    return F.concat(F.format_string("sec_%04d_", n), slug(title))


def path_stem(c: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")


def object_kind(c: Column) -> Column:
    """pdf, word or unsupported by the suffix in any case."""
    suffix = F.lower(F.regexp_extract(c, r"(?<=[^/])(\.[^./]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".doc", ".docx"), "word").otherwise("unsupported")


def document_identity(path: Column) -> dict[str, Column]:
    """Columns of a specification's file name: group, doc_type, subject, segments, release and version; null if it is none."""
    stem = path_stem(path)
    part = lambda i: F.regexp_extract(stem, DOCUMENT_ID, i)
    ok = stem.rlike(DOCUMENT_ID)
    segments = F.split(F.regexp_replace(part(2), r"^\.+", ""), r"\.")
    group = F.when(part(1).rlike(r"(?i)^WG\d+$"), F.concat(F.lit("WG"), F.substring(part(1), 3, 20))).otherwise(part(1))
    subject = F.when(F.size(segments) > 1, F.array_join(F.slice(segments, 2, 1000), "-")).otherwise(segments[0])
    return {
        "family": F.when(ok, "oran"), "doc_group": F.when(ok, group), "doc_type": F.when(ok, F.lower(segments[0])), "subject": F.when(ok, subject),
        "segments": F.when(ok, F.array_join(segments, ".")), "release_no": F.when(ok & (part(3) != ""), part(3)), "doc_version": F.when(ok, part(4)),
    }


def profile_id(identity: dict[str, Column], specs: Iterable[tuple[str, str | None, tuple[str, ...], tuple[str, ...]]] = (("oran_default", None, (), ()),), default: str = "default") -> Column:
    """First spec (profile, group, doc types, subject keywords; empty is any) that matches; ``default`` for other names."""
    out = F.lit(None).cast("string")
    for profile, group, types, keywords in reversed(list(specs)):
        cond = identity["family"].isNotNull()
        if group is not None:
            cond &= F.upper(identity["doc_group"]) == group.upper()
        if types:
            cond &= identity["doc_type"].isin(*types)
        if keywords:
            words = F.array(*[F.lit(k.lower()) for k in keywords])
            cond &= F.exists(words, lambda k: F.lower(identity["subject"]).contains(k))
        out = F.when(cond, profile).otherwise(out)
    return F.coalesce(out, F.lit(default))


def point_id(c: Column) -> Column:
    """UUID version 5 of the text in the URL namespace."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))  # fixed value of RFC 4122
    h = F.substring(F.sha1(F.concat(namespace, F.encode(c, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def sentences(c: Column) -> Column:
    """Array of the text's sentences, cut behind . ? ! and white space, stripped, blanks left out."""
    return F.filter(F.transform(F.split(strip(c), rf"(?<=[.?!])[{WS}]+"), strip), lambda s: s != "")


def token_count(c: Column) -> Column:
    """Number of tokens between white space."""
    return F.size(F.filter(F.split(c, f"[{WS}]+"), lambda s: s != ""))
