"""Persian text normalization: composed column expressions; Python only for rows that may not be in NFC."""

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docspark.functions.chars import FORMS, ONE_SPACE, PERSIAN, SPACE_RUN, count, let, strip

#: May hold something that NFC changes: marks, jamo, singletons, compatibility ideographs.
UNCOMPOSED = r"(?![\x00-\x{bf}])[\p{M}\x{340}-\x{37f}\x{387}\x{1100}-\x{11ff}\x{1f00}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{f900}-\x{faff}\x{fb1d}-\x{fb4e}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]"
#: Characters that go: invisible ones, diacritics, tatweel.
GONE = "".join(map(chr, (0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), *range(0x64B, 0x660), 0x670, 0x640)))
#: Letters, digits and marks folded one for one; the characters that go stand behind them without a counterpart.
FOLD_FROM = "يىكأإؤئةۀ" + "۰۱۲۳۴۵۶۷۸۹" + "٠١٢٣٤٥٦٧٨٩" + "،؛؟٬٫" + GONE
FOLD_TO = "ییکااویهه" + "0123456789" * 2 + ",;?,."
BEFORE_MARK = SPACE_RUN + r"([,:.!،؛؟])"
SPACES = r"[ \t\x{a0}\x{2000}-\x{200a}]+"


@lru_cache(maxsize=1)
def presentation_forms() -> dict[str, str]:
    """Arabic presentation forms that NFKC changes, and what to."""
    points = [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00)]
    return {chr(c): new for c in points if (new := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    return F.coalesce(_compose(F.when(text.rlike(UNCOMPOSED), text)), text)


def fold_forms(text: Column) -> Column:
    forms = F.from_json(F.lit(json.dumps(presentation_forms())), "map<string,string>")
    first, last = min(presentation_forms()), max(presentation_forms())  # only letters in this range are looked up

    def folded(t: Column) -> Column:
        letters = F.transform(F.split(t, ""), lambda c: F.when(c.between(first, last), F.coalesce(F.try_element_at(forms, c), c)).otherwise(c))
        return F.when(t.rlike(FORMS), F.array_join(letters, "")).otherwise(t)

    return let(text, folded)


def normalize_text(text: Column, composed: bool = False) -> Column:
    """The whole chain; null stays null. ``composed``: the input is known to be in NFC, no Python is planned."""
    t = fold_forms(text if composed else nfc(text))
    t = F.regexp_replace(F.translate(t, FOLD_FROM, FOLD_TO), BEFORE_MARK, "$1")
    t = F.regexp_replace(t, SPACES, " ")
    return strip(t)


def normalize_lines(lines: Column, composed: bool = True) -> Column:
    return F.filter(F.transform(lines, lambda x: normalize_text(x, composed)), lambda x: x != "")


def normalize_persian_text(text: Column) -> Column:
    return F.array_join(normalize_lines(F.split(nfc(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")), "\n")


def has_persian(text: Column) -> Column:
    return text.rlike(PERSIAN)


def persian_letter_ratio(text: Column) -> Column:
    return F.coalesce(count(text, PERSIAN) / F.nullif(F.length(text) - count(text, ONE_SPACE), F.lit(0)), F.lit(0.0))


def is_mostly_persian(text: Column, threshold: float = 0.35) -> Column:
    letters = count(text, r"\p{L}")
    return F.coalesce(count(text, r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}&&\p{L}]") / F.nullif(letters, F.lit(0)) >= threshold, F.lit(False))
