"""Character classes, spelled for Java and RE2 alike, and Unicode-aware trimming and splitting."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Ends a try at most letters at once, where the classes above would be gone through range by range.
_NOT_SPACE = r"(?![!-~\x{a1}-\x{167f}])"
ONE_SPACE, SPACE_RUN = _NOT_SPACE + WS, f"{_NOT_SPACE}{WS}+"
PERSIAN = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
PERSIAN_NO_FORMS_B = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{fb50}-\x{fdff}]"
PRIVATE, REPLACED, CONTROL = r"[\x{e000}-\x{f8ff}]", r"\x{fffd}", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
READABLE = r"[\p{L}\p{N}\n\r\t \x{200c}]"
FORMS = r"[\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def filter_once(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows where ``condition`` holds, by columns that are computed once a row.

    The row number keeps the filter above them: pushed below, it would compute each as often as the condition comes
    upon it.
    """
    return rows.withColumn("_row", F.monotonically_increasing_id()).filter(condition & (F.col("_row") >= 0)).drop("_row")


def strip(text: Column) -> Column:
    """Without white space at both ends; only texts that have some there are searched."""
    edges = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(edges.rlike(ONE_SPACE), F.regexp_replace(text, f"^{WS}+|{SPACE_RUN}$", "")).otherwise(text)


def count(text: Column, one: str) -> Column:
    """How many characters match the class ``one``: what is gone without their runs. No list of matches is made."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{one}+", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, "")
