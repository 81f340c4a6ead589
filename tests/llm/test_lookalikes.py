import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.llm.lookalikes import BASE, PLAIN, canonicalize, changed_rows, consistent_form, unicode_twins

CASES = {
    "ｆｕｌｌ Ｗ４": "full W4", "e\u0301te\u0301": "été", "a\u200bb\u00adc\ufeff": "abc", "a\u00a0b\u2007c\u3000d": "a b c d", "ﬁne oﬀ": "fine off", "5 Ω, 290 K": "5 Ω, 290 K",
    "node‑70": "node-70", "раcket": "packet", "ThresholdЕpochΑck": "ThresholdEpochAck", "The МАС and ΡΗΥ": "The MAC and PHY", "κЛbit": "κЛbit", "dВm": "dBm", "µs": "μs",
}
SAME = ["kΩ", "μs", "Δf and Δφ", "α-fairness", "σ²", "Gloss: задержка.", "он и она", "x\u0302 and q\u0304", "m² ± 3 → ß", "línea\ttab\r\n", "", "naïve Übergabe", "задержка СОР задержка"]


@pytest.mark.parametrize("text", CASES)
def test_changed(text):
    assert consistent_form(text) == CASES[text]
    assert consistent_form(CASES[text]) == CASES[text]


@pytest.mark.parametrize("text", SAME)
def test_kept(text):
    assert consistent_form(unicodedata.normalize("NFC", text)) == unicodedata.normalize("NFC", text)


def test_latin_in_a_word_of_another_script():
    assert consistent_form("зaдержка") == "задержка"


def test_frames(spark):
    rows = [(1, "plain", 1), (2, "a\u200bb", 1), (2, "a\u200bb", 1), (3, None, 1), (4, "", 1), (None, "ﬁ", 1), (5, "ﬁ" + "x" * 200_000, 1), (6, "Ω", None)]
    df = spark.createDataFrame(rows, "block_key bigint, text string, key int").withColumn("form", F.lit("clash"))
    assert sorted(r.key for r in changed_rows(df, "block_key", "text").collect()) == [2, 5]
    got = {r.block_key: r.form for r in canonicalize(df, "text").where("block_key is not null").collect()}
    assert got[1] == "plain" and got[2] == "ab" and got[3] is None and got[4] == "" and got[5][:3] == "fix" and got[6] == "Ω"
    assert changed_rows(df.limit(0), "block_key", "text").count() == 0


def test_plain_characters_have_no_other_form(spark):
    plain = re.compile(f"[{PLAIN}]")
    assert not [c for c in BASE.latin if plain.match(c)]
    assert not [c for c in map(chr, range(0x20, 0x2800)) if plain.match(c) and consistent_form(f"a{c}b") != f"a{c}b"]
    df = spark.createDataFrame([(1, "lo\u0261ic"), (2, "logic")], "k bigint, t string")
    assert [r.key for r in changed_rows(df, "k", "t").collect()] == [1]
    assert {r.k: r.form for r in canonicalize(df, "t").collect()} == {1: "logic", 2: "logic"}


def test_latin_letters_take_the_usual_twin():
    assert [consistent_form(t) for t in ("Yдар", "Iван", "зaдержкa")] == ["Удар", "Іван", "задержка"]


def test_alphabets_and_styles_by_unicode_rules(spark):
    twins = unicode_twins(spark)
    wanted = {"Ꭺpple": "Apple", "\U0001d400pple": "Apple", "ꓮpple": "Apple", "ℋello": "Hello", "ﾊﾝｶｸ": "ハンカク", "ⅠX": "IX", "Bօx": "Box", "ｶﾞ": "ガ"}
    assert {t: twins.form(t) for t in wanted} == wanted
    kept = ["ℓ = 3", "x ∈ ℝ", "Ուրբաթ", "ᏣᎳᎩ", "თბილისი", "角 CPU工作"]
    assert [twins.form(t) for t in kept] == kept
    for letter, latin in twins.latin.items():
        assert latin.isascii() and twins.form(f"ab{letter}cd") == f"ab{latin}cd", letter


@pytest.mark.parametrize("text", [*CASES, *SAME, "á​­b ｶﾞ é ﬁx", "​x"])
def test_aligned_form_and_places(text):
    form, places = BASE.aligned(text)
    assert form == consistent_form(text) or unicodedata.normalize("NFC", form) == consistent_form(text)
    assert len(places) == len(form) and places == sorted(places) and all(text[p] == c for c, p in zip(form, places) if c.isascii() and c in text and text.isascii())
