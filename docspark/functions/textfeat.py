"""Text features of blocks and lines, tokens and page lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.chars import WS, compact, count, strip, words
from docspark.functions.normalize import normalize_text

DIGITS_FROM, DIGITS_TO = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "0123456789" * 2
# The letters of a formula.
FORMULA = r"^[A-Za-z0-9+\-=→×·⇌()\[\]γδθλµ]{2,}$"
# Phrases of download banners, without white space. The names of a source are added by the caller.
FOOTER_MARKS = ("دانلوداز", "وبسایت", "وبسايت", "اپليکيشن", "اپلیکیشن", "اپلكيش")
CHARS_PER_TOKEN = 3.2
SENTENCE_END = rf"(?<=[.?!؟…]){WS}+|\n"


def looks_like_formula(text: Column) -> Column:
    t = F.translate(F.replace(text, F.lit(" "), F.lit("")), DIGITS_FROM, DIGITS_TO)
    return (F.length(t) <= 60) & (t.rlike(FORMULA) & t.rlike("[0-9]") | t.rlike("[A-Z][a-z]?[0-9]") & t.rlike("[+=→⇌-]"))


def looks_like_english(text: Column, c: Column | None = None) -> Column:
    t = compact(text) if c is None else c
    letters = count(t, "[A-Za-z]")
    return t.rlike(r"^[\x00-\x7f]*$") & (letters >= 3) & (10 * letters >= 7 * F.length(t))


def letter_spam_ratio(text: Column, w: Column | None = None) -> Column:
    """``w``: the text's words, if they are at hand; so below."""
    w = words(text) if w is None else w
    return F.when(F.size(w) < 3, 0.0).otherwise(F.size(F.filter(w, lambda x: F.length(x) <= 2)) / F.greatest(F.size(w), F.lit(1)))


def is_decorative(text: Column, c: Column | None = None) -> Column:
    """``c``: the text without white space, if it is at hand; so below."""
    return F.translate(compact(text) if c is None else c, DIGITS_FROM, DIGITS_TO).rlike("^[0Oo°○]{1,8}$")


def bare(token: Column) -> Column:
    return F.regexp_replace(token, r"^[().,]+|[().,]+$", "")


def looks_like_chart_label(text: Column, w: Column | None = None) -> Column:
    w = words(text) if w is None else w
    return (F.size(w) <= 3) & (text.rlike("[%٪]") | F.exists(w, lambda x: bare(x).rlike(r"^\p{Nd}+$") | (F.length(bare(x)) <= 5) & bare(x).rlike(r"^\p{Nd}")))


def looks_like_footer(text: Column, marks: tuple[str, ...] = FOOTER_MARKS, c: Column | None = None) -> Column:
    t = compact(text) if c is None else c
    found = F.lit(False)
    for mark in marks:
        found = found | t.contains(mark)
    return found


def tokenize(text: Column, composed: bool = False) -> Column:
    return F.filter(words(normalize_text(text, composed)), lambda t: F.length(t) >= 2)


def estimate_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.rint(n / F.lit(chars_per_token)).cast("int")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def parse_pages(spec: Column) -> Column:
    """'1,2,5-9' as sorted distinct numbers; blank: null."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: strip(x).cast("int")))
    spans = F.transform(ends, lambda e: F.when(F.size(e) == 1, F.array(e[0])).when(e[0] <= F.get(e, F.lit(1)), F.sequence(e[0], F.get(e, F.lit(1)))).otherwise(F.array().cast("array<int>")))
    return F.when(strip(F.coalesce(spec, F.lit(""))) != "", F.array_sort(F.array_distinct(F.flatten(spans))))


def select_pages(pages: Column, page_count: Column) -> Column:
    """Sorted distinct pages in range; an empty selection means all pages (null)."""
    inside = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.between(1, page_count))))
    return F.when(F.size(inside) > 0, inside)
