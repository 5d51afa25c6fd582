"""Licence scan: canonical digests of entire texts, hash-joined to digests of known licences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.license_texts import DIGESTS, KNOWN, TITLES

#: In order, on lower-case text: (pattern, replacement), the same in Java, RE2 and Python.
STEPS = [
    (r"(?:^|\n)[ \t#*/;-]*(?:copyright[ \t]+(?:\(c\)|©|[0-9<\[])|\(c\)[ \t]+(?:copyright|[0-9])|©|all rights reserved)[^\n]*", " "),
    (r"[^0-9a-z\x{A9}-\x{1FFF}\x{2C00}-\x{10FFFF}]+", " "),
    (r"licence", "license"), (r"\bsub license", "sublicense"), (r"\bnon infringement", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"), (r"\bcopyright (?:owner|holder)s?\b", "copyright holder"), (r"\backnowledgement", "acknowledgment"),
    (r"\bfavour", "favor"), (r"\b(author|organ|util)is", "$1iz"), (r"\bhttps\b", "http"),
    (r"^ +| +$", ""),
]


#: Known digests up to which they are broadcast: some 100 bytes each.
BROADCAST_ROWS = 100_000
BLANK_LINE, HEAD_WORDS = r"\n[ \t\r]*\n", "(?i)licen[sc]e|permission|redistribution"


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, new in STEPS:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(new))
    return t


def canonical_py(text: str) -> str:
    t = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    for pattern, new in STEPS:
        pattern = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
        t = re.sub(pattern, new.replace("$1", r"\1"), t, flags=re.A)
    return t


def spellings(name: str, text: str) -> list[str]:
    """The text as listed, without a title and under each usual one; its numbered points also as bullets."""
    titles = TITLES.get(name, ())
    head, _, rest = text.partition("\n\n")
    body = rest if head in titles else text
    bodies = dict.fromkeys((body, re.sub(r"(?m)^\d\. ", "* ", body)))
    return [text, *(f"{title}\n\n{x}" if title else x for x in bodies for title in ("", *titles))]


def digests_of(names: Iterable[str]) -> dict[str, str]:
    return {hashlib.sha256(canonical_py(x).encode()).hexdigest(): name for name in names for x in spellings(name, KNOWN[name])}


def known_digests() -> dict[str, str]:
    return DIGESTS | digests_of(KNOWN)


def notice_digests() -> dict[str, str]:
    """Those of the known texts that are one line."""
    return digests_of(name for name, text in KNOWN.items() if "\n" not in text and len(text) < 100)


def known_table(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """digest, license_id: the built-in list and, if given, ``texts`` (license_id, text) by the digests of their canonical form."""
    own = spark.createDataFrame(sorted(known_digests().items()), "digest string, license_id string")
    return own if texts is None else own.unionByName(texts.select(digest(F.col("text")).alias("digest"), "license_id"))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def head(text: Column) -> Column:
    """The leading block, up to the first blank line; null if the text has no further one or its block names no licence."""
    t = F.regexp_replace(text, r"^[ \t\r\n]+", "")
    blocks = F.split(t, BLANK_LINE, 2)
    return F.when((F.size(blocks) > 1) & blocks[0].rlike(HEAD_WORDS), blocks[0])


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, digest, license_id, header_id, notices for every row.

    ``known``: digest, license_id of the canonical texts to look for (``known_table`` makes it; without it, the built-in
    list); of several names for a digest the first counts. ``license_id``: the licence that the entire text is, or null.
    ``header_id``: the one that its leading block is, if more follows. Both come from a hash join, by broadcast while
    the list is BROADCAST_ROWS at most. ``notices``: built-in notices that single lines are, sorted, without repeats; a
    line can only be one if it names a licence. Null and empty texts match nothing. Repeated rows get equal answers; an
    empty table gives no row; further columns are not read.
    """
    known = (known_table(docs.sparkSession) if known is None else known).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = F.broadcast(known) if small else known
    notices = F.create_map(*(F.lit(x) for pair in sorted(notice_digests().items()) for x in pair))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("(?i)licen[sc]e"))
    found = F.transform(lines, lambda x: F.try_element_at(notices, digest(x)))
    top = head(F.col(text))
    rows = docs.select("doc_id", digest(F.col(text)).alias("digest"), F.when(top.isNotNull(), digest(top)).alias("head"), F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("notices"))
    headers = known.select(F.col("digest").alias("head"), F.col("license_id").alias("header_id"))
    headers = F.broadcast(headers) if small else headers
    return rows.join(known, "digest", "left").join(headers, "head", "left").select("doc_id", "digest", "license_id", "header_id", "notices")
