"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, chat, exact, html_main, langid, licenses, packing, pipeline, quality, sharding, simhash
from docspark.llm.common import table, tokenizer
from docspark.llm.pipeline import END_ID, POLICY, WINDOW

SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(own).withColumn("parts", chat.text_parts(F.col("text")))))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), tokenizer(), END_ID, WINDOW)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.assign(docs, exact.DigestIndex(spark)).withColumnRenamed("digest", "text_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.col("failed")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.BASE.kept(failed)).alias("base_failed"), (quality.BASE.kept(failed) & quality.POLICIES[POLICY].kept(failed)).alias("kept"), "failed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer(), decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.training_sample(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_chat_formatting, op3_packing, op4_license_scan, op5_exact_dedup, op6_quality_rules, op7_simhash, op8_bpe, op9_html_extraction, op10_language_id)
    return {f.__name__: f for f in found} | {"pipeline": pipeline.run}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_sql() -> str:
    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in chat.CONTROL:
            x = f"replace({x}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
        return x

    own = ", ".join(f"(-7, {n}, {quoted(role)}, '</s>[INST] ok [/INST]')" for n, role in enumerate(("user", "assistant")))
    marks = len(chat.START + chat.BODY + chat.END)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES {own}) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({escaped("role")}) + length({escaped("text")}) + {marks}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def license_sql() -> str:
    def canonical(x: str) -> str:
        x = LOWER.format(x)
        for pattern, new in licenses.STEPS:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new.replace('$1', chr(92) + '1'))}, 'g')"
        return x

    def listed(found: dict[str, str]) -> str:
        return ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted(found.items()))

    return f"""
WITH known(digest, license_id) AS (VALUES {listed(licenses.known_digests())}),
notice(digest, license_id) AS (VALUES {listed(licenses.notice_digests())}),
b AS (SELECT *, string_split_regex(regexp_replace(text, '^[ \\t\\r\\n]+', ''), {quoted(licenses.BLANK_LINE)}) AS blocks FROM documents),
d AS (SELECT doc_id, sha256({canonical("coalesce(text, '')")}) AS digest, CASE WHEN len(blocks) > 1 AND regexp_matches(blocks[1], {quoted(licenses.HEAD_WORDS)}) THEN sha256({canonical("blocks[1]")}) END AS head FROM b),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS notices
      FROM l JOIN notice ON notice.digest = sha256({canonical("line")}) WHERE regexp_matches(line, '(?i)licen[sc]e') GROUP BY doc_id)
SELECT d.doc_id, d.digest, known.license_id, h.license_id AS header_id, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN known h ON h.digest = d.head LEFT JOIN n ON n.doc_id = d.doc_id"""


EXACT_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS x FROM w, unnest(range(1, len(ws) - 6)) AS r(i)),
rep AS (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM win SEMI JOIN rep USING (doc_id, x), unnest(range(8)) AS r(k)),
covered AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (n_symbols > n_words)::INT
                     + 8 * (word_chars > 25 * n_words)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (5 * n_dup_lines > n_words)::INT AS BIGINT) AS failed FROM m)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat_sql(), "op4_license_scan": license_sql(), "op5_exact_dedup": EXACT_SQL, "op6_quality_rules": QUALITY_SQL}
