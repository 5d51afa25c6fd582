import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docspark.llm import bpe, chat, exact, html_main, langid, licenses, nearcopies, packing, prefixes, quality, queries, sharding, simhash
from docspark.llm.components import components, forest
from docspark.llm.license_texts import KNOWN

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
#: Nulls, empty and blank texts, ties, repeated rows, a very long text; columns that clash with the operators' own.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "Same text here", "en", "s", 1), (5, "same TEXT here", "en", "s", 1), (5, "same TEXT here", "en", "s", 1), (None, "no id", "en", "s", 1), (7, LONG, "fr", "s", 1), (8, "ünï cödé 😀 <|endoftext|>", "de", None, 2)]


def odd(spark):
    clash = {c: F.lit("x") for c in ("fp", "digest", "ids", "n_words", "shard", "failed", "_text", "_d", "lang_pred", "rows", "size", "keep_id")}
    return spark.createDataFrame(ODD, DOCS).withColumns(clash)


def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]

    def rows(frame):
        return sorted((tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)

    assert rows(got) == rows(want)


def test_sharding(spark):
    rows = [(i, "hot text" if i % 3 else "t" * (i % 700), None, None, None) for i in range(6000)]
    got = pd.DataFrame([r.asDict() for r in sharding.shard(spark.createDataFrame(rows, DOCS)).collect()])
    assert len(got) == 6000 and set(got["shard"]) == set(range(40))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert (sizes - sizes.mean()).abs().max() <= got["size"].max()
    assert all(r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) for r, t in ((r, rows[r["doc_id"]][1]) for r in got.to_dict("records")))
    assert sorted(str(r.doc_id) for r in sharding.shard(odd(spark)).collect()) == sorted(str(r[0]) for r in ODD)
    assert sharding.shard(none(spark)).count() == 0


def test_sharding_query_keeps_its_law(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_sharding(spark, SF).toPandas()
    assert sorted(got["doc_id"]) == sorted(docs) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.to_dict("records"):
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (sizes - sizes.mean()).abs().max() <= got["size"].max()


def test_sharding_splits_repeated_rows_and_grows_its_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_PART", 50)
    seen, sql = [], type(none(spark)).groupBy

    def watched(self, *columns):
        if columns == ("range", "part"):
            seen.append(max(r[2] for r in sql(self, *columns).agg(F.count("*")).collect()))
        return sql(self, *columns)

    monkeypatch.setattr(type(none(spark)), "groupBy", watched)
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit(7)).alias("doc_id"), F.lit("the same text").alias("text"))
    got = sharding.shard(docs).toPandas()
    assert seen[0] <= 120 and len(got) == 9000 and got.groupby("shard").size().tolist() == [225] * 40


def test_boundaries_give_a_hot_key_its_own_range():
    cuts = sharding.boundaries([(5, 1.0)] * 90 + [(k, 1.0) for k in range(6, 16)], 10)
    assert 5 in cuts and 6 in cuts and cuts == sorted(set(cuts))
    assert sharding.boundaries([], 4) == []


def test_chat_reads_back(spark):
    texts = ["a\\b", "<|end|>", "\\</s>", "[INST]", "<<SYS>><</SYS>>", "\\\\", "", None, "x\ny", "<|image:0|>"]
    rows = [(9, n, ("user", "assistant", "sy\n<|body|>", None)[n % 4], t) for n, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    formatted = chat.format_turns(turns).orderBy("turn").collect()
    assert [chat.read_turn(r.formatted) for r in formatted] == [(r or "", t or "") for _, _, r, t in rows]
    for r in formatted:
        inner = r.formatted.removeprefix(chat.START).removesuffix(chat.END)
        assert inner.count(chat.BODY) == 1 and not any(c in inner.replace(chat.BODY, "") for c in chat.CONTROL)
    got = chat.read_back(chat.format_turns(turns)).first()
    masked = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (10, len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_null_conversations_and_repeated_turns(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, None, None), (1, 2, "assistant", "x" * 100_000), (1, 2, "assistant", "x" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": chat.text_parts(F.col("text")), "content": F.lit("clash"), "head": F.lit("clash")})
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.turns_sha256) for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got == {None: (3, 1, hashlib.sha256(b"user\na\nuser\na\nassistant\nb\n").hexdigest()), 1: (3, 200_000, hashlib.sha256(("\n\n" + f"assistant\n{'x' * 100_000}\n" * 2).encode()).hexdigest())}


def test_chat_parts(spark):
    part = [("text", "see <s>", None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None), ("audio", None, "b.wav", None, None, 2.5, None), None, ("document", None, "c.pdf", None, None, None, 3), ("other", None, None, None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", part)], f"conv_id long, turn long, role string, parts array<struct<{chat.PART.replace(' ', ':').replace(',:', ',')}>>")
    got = chat.format_turns(turns).first()
    assert got.formatted == "<|turn|>user<|body|>see <\\s><|image:0|><|audio:1|><|document:2|><|end|>"
    assert [(a.n, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, "image", "a.png", 6), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1536)]
    assert got.expanded_tokens == 1605 and got.loss_start is None


def test_bpe_equals_library(spark):
    own, lib, reference = bpe.ByteBPE(PATH), bpe.LibraryBPE(PATH), Tokenizer.from_file(PATH)
    rnd, texts = random.Random(5), [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + [LONG, "", " ", "a  b \n c ", "x<|endoftext|>y"]
    texts += ["".join(rnd.choice([" ", "  ", "\n", "\xa0", "'s", "'ll", "12", "é", "😀", "\x1c", "漢", "abc", "<|endoftext|>"]) for _ in range(rnd.randrange(15))) for _ in range(500)]
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == np.frombuffer(lib.encode(t), "<u4").tolist() == want
        assert own.decode(own.encode(t)) == reference.decode(want, skip_special_tokens=False)
    got = bpe.decode_ids(bpe.encode_texts(odd(spark), PATH), PATH).collect()
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in ODD)
    assert sorted(map(tuple, bpe.encode_texts(odd(spark), PATH, decoded=True).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert bpe.encode_texts(none(spark), PATH).count() == 0


def test_bpe_query_against_library(spark):
    docs, reference = spark.read.parquet(f"{SF}/documents.parquet").collect(), Tokenizer.from_file(PATH)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_bpe(spark, SF).collect()}
    for r in docs:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def packed_whole(spark, docs):
    coder = Tokenizer.from_file(PATH)
    want = sorted((str(d), tuple([*coder.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in docs.select("doc_id", "text").collect())
    pieces = packing.pack_documents(docs, PATH, 1).toPandas()
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        total = int(part["length"].sum())
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    return want, pieces


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, pieces = packed_whole(spark, docs)
    got = []
    for d, part in pieces.groupby("doc_id"):
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        got.append((str(d), tuple(np.frombuffer(b"".join(part["ids"]), "<u4").tolist())))
    assert sorted(got) == want
    assert packing.pack_documents(none(spark), PATH, 1).count() == 0
    want, pieces = packed_whole(spark, odd(spark))
    assert sum(len(ids) for _, ids in want) == pieces["length"].sum()


def counted(ids):
    return np.unique(np.array(ids), return_counts=True)


def test_bm25_against_its_formula():
    rnd = np.random.default_rng(2)
    docs = [rnd.integers(0, 40, rnd.integers(0, 30)) for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    corpus = packing.Statistics(len(docs), sum(map(len, docs)), df)
    index = packing.Bm25([(*counted(d), len(d)) for d in docs[:20]], corpus)
    for seed in range(20):
        for i, d in enumerate(docs[:20]):
            want = 0.0
            for t in set(docs[seed].tolist()) & set(d.tolist()):
                tf = (d == t).sum()
                want += max(0, np.log((60 - df[t] + 0.5) / (df[t] + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / (sum(map(len, docs)) / 60)))
            assert abs(index.scores(seed)[i] - want) < 1e-9


def test_packing_statistics_are_those_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    tokens = packing.tokenized(docs, PATH, 1, "<u2")
    got, coder = packing.statistics(tokens, 2), Tokenizer.from_file(PATH)
    ids = [coder.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()]
    assert (got.df == np.bincount(np.concatenate([np.unique(x).astype(int) for x in ids]), minlength=len(got.df))).all()
    assert abs(got.mean - sum(len(x) + 1 for x in ids) / len(ids)) < 0.01


def test_packing_puts_neighbours_side_by_side(spark):
    rnd = random.Random(12)
    topics = [[f"{rnd.choice('bcdfg')}{rnd.randrange(10**6)}" for _ in range(12)] for _ in range(150)]
    rows = [(i, " ".join(rnd.choices(topics[i % 150], k=60)), None, None, None) for i in range(1500)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(7), PATH, 1).toPandas()
    together = pieces.groupby("sequence_id")["doc_id"].apply(lambda d: len(d) - len(set(x % 150 for x in d)))
    assert together.sum() > 0.5 * len(pieces)


def test_packing_choice_against_plain_version():
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(2, 90, rnd.integers(1, 50)).astype("<u2") for _ in range(80)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=90)
    corpus = packing.Statistics(80, sum(map(len, docs)), df)
    packer = packing.Packer(64, 0, corpus)
    for i, d in enumerate(docs):
        packer.add(i, d, *counted(d))
    packer.pack(0)
    index = packing.Bm25([(*counted(d), len(d)) for d in docs], corpus)
    rest, want, left = {i: 0 for i in range(80)}, [], sum(map(len, docs))
    for seed in sorted(range(80), key=lambda i: -len(docs[i])):
        if seed not in rest or left < 64:
            continue
        parts, room = [(seed, rest[seed])], 64 - len(docs[seed]) + rest.pop(seed)
        near = sorted(rest, key=lambda i: (-index.scores(seed)[i], i))
        while room:
            i = next((i for i in near if len(docs[i]) - rest[i] <= room), near[0])
            parts.append((i, rest[i]))
            if (n := len(docs[i]) - rest[i]) <= room:
                room -= n
                del rest[i]
                near.remove(i)
            else:
                rest[i] += room
                room = 0
        left -= 64
        want.append(parts)
    got = {}
    for doc, start, _, _, sequence, _ in packer.out:
        got.setdefault(sequence, []).append((doc, start))
    assert list(got.values())[: len(want) - 1] == want[:-1]


def test_packing_finds_long_documents_by_their_head():
    rnd, docs = np.random.default_rng(3), {}
    docs["long"] = np.array([*range(1000, 1064), *range(60)], "<u2")
    docs["near"] = np.array([1000, 1001, 1002, 1003], "<u2")
    docs |= {i: rnd.integers(0, 60, 4).astype("<u2") for i in range(40)}
    df = np.bincount(np.concatenate([np.unique(d) for d in docs.values()]))
    packer = packing.Packer(64, 0, packing.Statistics(len(docs), sum(map(len, docs.values())), df))
    for doc, ids in docs.items():
        packer.add(doc, ids, *counted(ids))
    packer.finish()
    (sequence,) = (s for doc, start, _, _, s, _ in packer.out if doc == "long" and start == 64)
    assert {doc for doc, _, _, _, s, _ in packer.out if s == sequence} == {"long", "near"}


def test_packing_searches_fewer_long_documents_at_once(monkeypatch):
    rnd, made, bm25 = np.random.default_rng(6), [], packing.Bm25
    monkeypatch.setattr(packing, "POSTINGS", 20_000, raising=False)
    monkeypatch.setattr(packing, "Bm25", lambda rows, corpus: made.append(sum(len(t) for t, _, _ in rows)) or bm25(rows, corpus))
    docs = [rnd.permutation(2000)[:500].astype("<u2") for _ in range(300)]
    packer = packing.Packer(64, 0, packing.Statistics(300, 150_000, np.bincount(np.concatenate(docs), minlength=2000)))
    for i, d in enumerate(docs):
        packer.add(i, d, *counted(d))
    packer.finish()
    assert max(made) <= 20_000 + 500 * (packing.CARRY + 1)
    for i, d in enumerate(docs):
        parts = sorted((start, ids) for doc, start, ids, _, _, _ in packer.out if doc == i)
        assert np.frombuffer(b"".join(x for _, x in parts), "<u4").tolist() == d.tolist()


def test_packing_steps_are_bounded_by_bytes():
    texts = ["", None, "x" * 10, "yyy", "zzz", "zzz", "w" * 100, None, "", "", "", "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts, pa.string())], ["doc_id", "text"]).slice(1)
    parts = [p.column(1).to_pylist() for p in packing.portions(batch, 1, 3, 10)]
    assert parts == [[None, "x" * 10], ["yyy", "zzz", "zzz"], ["w" * 100], [None, "", ""], ["", "v"]]
    assert list(packing.portions(batch.slice(0, 0), 1, 3, 10)) == []


def test_licenses(spark):
    texts = {f"{k}{v}": t for k, t in KNOWN.items() for v, t in enumerate((t, t.upper(), "Copyright (c) 2020 Someone\n\n" + t.replace("license", "licence").replace(",", " ,"), "(c) 2011 A\n" + t.replace("\n", "\n   ")))}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts.values())], DOCS)
    got = {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [k[:-1] for k in texts]
    assert all(r.license_id is None and r.notices == [] for r in licenses.scan(odd(spark)).collect())
    mixed = spark.createDataFrame([(1, "Text.\nReleased under the MIT licence", None, None, None)], DOCS)
    assert licenses.scan(mixed).first().notices == ["MIT-notice"] and licenses.scan(none(spark)).count() == 0


def test_licenses_with_titles_and_long_texts(spark):
    body, owner = KNOWN["MIT"].partition("\n\n")[2], "\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n"
    texts = [("MIT", body), ("MIT", "The MIT License (MIT)" + owner + body), ("ISC", "ISC License" + owner + KNOWN["ISC"]), ("BSD-3-Clause", "BSD 3-Clause License" + owner + KNOWN["BSD-3-Clause"]), ("BSD-2-Clause", KNOWN["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")), (None, body + " Not for sale.")]
    folder, end = "/usr/share/common-licenses", "END OF TERMS AND CONDITIONS"
    for f, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")):
        if os.path.exists(f"{folder}/{f}"):
            with open(f"{folder}/{f}", encoding="utf-8") as file:
                text = file.read()
            texts += [(name, text), (name, text.partition(end)[0]), (None, text[: len(text) // 3])]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([(i, t, None, None, None) for i, (_, t) in enumerate(texts)], DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]


@pytest.mark.parametrize("most", [100_000, 3])
def test_licenses_of_a_given_table_and_headers(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
    long = "Own Public License\n\n" + "You may use this, copy it and give it away, by the terms of this licence. " * 200
    texts = spark.createDataFrame([("Own-1.0", long), ("Own-1.0-b", long), ("Short", "Use is free by this license, for all.")], "license_id string, text string")
    apache = "/*\n * Copyright 2020 Someone\n *\n * " + KNOWN["Apache-2.0-header"].replace("\n\n", "\n *\n * ") + "\n */\n\npackage a;\n\nclass B {}"
    rows = [(1, "Copyright (c) 2011 A\n" + long.upper().replace("LICENCE", "license"), None, None, None), (2, apache, None, None, None), (3, "# (c) 2011 A\n# Use is free by this licence -- for all\n\nx = 1\n", None, None, None), (4, long + "not", None, None, None), (5, KNOWN["MIT"], None, None, None), (6, "\n\n" + KNOWN["MIT-notice"] + "\n \nText", None, None, None)]
    got = {r.doc_id: (r.license_id, r.header_id) for r in licenses.scan(spark.createDataFrame(rows, DOCS), licenses.known_table(spark, texts)).collect()}
    assert got == {1: ("Own-1.0", None), 2: (None, "Apache-2.0-header"), 3: (None, "Short"), 4: (None, None), 5: ("MIT", None), 6: (None, "MIT-notice")}


def test_exact_dedup_and_persistent_index(spark):
    got = exact.assign(odd(spark), exact.DigestIndex(spark)).collect()
    assert len(got) == len(ODD)
    same = [r for r in got if r.doc_id in (4, 5)]
    assert {r.keep_id for r in same} == {5} and {r.group_size for r in same} == {3} and sum(r.kept for r in same) == 1
    assert {r.doc_id: r.kept for r in got if r.doc_id in (1, 2)} == {1: False, 2: True}
    assert sum(r.kept for r in got if r.doc_id is None) == 1
    assert exact.keep_one(odd(spark), exact.DigestIndex(spark)).count() == 6
    index = exact.DigestIndex(spark)
    assert exact.assign(none(spark), index).count() == 0
    exact.assign(odd(spark), index).count()
    more = spark.createDataFrame([(9, "SAME text here", None, None, None), (10, "new", None, None, None)], DOCS)
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact.assign(more, exact.DigestIndex(spark, index.location, index.buckets)).collect()} == {9: (5, False), 10: (10, True)}
    assert index.read().count() == 7


def test_digest_index_is_joined_by_sort_merge(spark, monkeypatch):
    plans, join = [], type(odd(spark)).join

    def seen(self, other, on=None, how=None):
        found = join(self, other, on, how)
        if on == "digest" and ("keep_id" in other.columns or how == "left_anti"):
            plans.append(found._jdf.queryExecution().sparkPlan().toString())
        return found

    index = exact.DigestIndex(spark)
    exact.assign(spark.createDataFrame([(1, "a")], "doc_id long, text string"), index)
    monkeypatch.setattr(type(odd(spark)), "join", seen)
    exact.assign(spark.createDataFrame([(2, "b")], "doc_id long, text string"), index)
    assert sum("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans) == 2


def batch_of(spark, ids):
    return spark.createDataFrame([(i, f"text {i % 60}", None, None, None) for i in ids], DOCS)


def test_digest_index_refuses_other_bucket_counts(spark):
    index = exact.DigestIndex(spark, buckets=4)
    assert exact.assign(batch_of(spark, range(60)), index).filter("kept").count() == 60
    spark.sql(f"DROP TABLE {index.table('data')}")
    with pytest.raises(ValueError, match="buckets"):
        exact.DigestIndex(spark, index.location, 7)
    again = exact.DigestIndex(spark, index.location)
    assert again.buckets == 4 and exact.assign(batch_of(spark, range(60, 120)), again).filter("kept").count() == 0 and again.read().count() == 60


def test_digest_index_gives_a_batch_the_same_rows_again(spark, monkeypatch):
    index = exact.DigestIndex(spark)
    write, fail = exact.put_new, []
    monkeypatch.setattr(exact, "put_new", lambda spark, path, text: not fail.append(path) and False)
    with pytest.raises(RuntimeError):
        exact.assign(batch_of(spark, range(40)), index, batch="a")  # rows are written, the log entry is not
    monkeypatch.setattr(exact, "put_new", write)
    first = sorted(map(tuple, exact.assign(batch_of(spark, range(40)), index, batch="a").collect()))
    assert sum(r[3] for r in first) == 40 and index.read().count() == 40
    exact.assign(batch_of(spark, range(70)), index, batch="b")
    index.compact()
    assert sorted(map(tuple, exact.assign(batch_of(spark, range(40)), index, batch="a").collect())) == first
    got = exact.assign(batch_of(spark, range(70)), exact.DigestIndex(spark, index.location), batch="b").collect()
    assert sum(r.kept for r in got) == 20 and index.read().count() == 60


def test_digest_index_is_compacted(spark, monkeypatch):
    monkeypatch.setattr(exact, "COMPACT_AFTER", 2)
    index = exact.DigestIndex(spark, buckets=2)
    for n in range(3):
        assert exact.assign(batch_of(spark, range(20 * n, 20 * n + 20)), index).filter("kept").count() == 20
    assert index.folder(index.log()) != "data" and index.read().count() == 60


def repeated_words(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            covered.update(p for i in starts for p in range(i, i + 8))
    return len(words), len(covered)


def test_quality(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["a " * 40] + [r[1] for r in ODD]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    entries = quality.ledger(docs)
    for r in entries.collect():
        assert (r.n_words, r.n_repeat_words) == repeated_words(texts[r.doc_id])
    lines = spark.createDataFrame([(1, "a\na\n\n\nb\r\na #$", None, None, None)], DOCS)
    r = quality.ledger(lines).first()
    assert (r.n_dup_lines, r.n_symbols, r.word_chars) == (1, 2, 6)
    table = {r.rule: r for r in quality.ablations(entries, quality.POLICIES["v1"]).collect()}
    fails = [r.failed for r in entries.collect()]
    assert table["few_words"].fails == sum(f & 1 for f in fails) and table["few_words"].dropped == sum(f > 0 for f in fails)
    assert table["repeated_windows"].dropped_without == sum(f & ~2 > 0 for f in fails)
    kept = quality.keep_good(odd(spark), quality.POLICIES["v1"])
    assert kept.columns == odd(spark).columns and kept.count() == 0 and quality.ledger(none(spark)).count() == 0


def plain_fingerprint(text):
    words = __import__("re").findall("[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    root = list(range(len(fingerprints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fingerprints)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fingerprints))]


def test_simhash_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in docs]
    want = [(r.doc_id, f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, plain_components(prints), strict=True)]
    assert sorted(map(tuple, queries.op7_simhash(spark, SF).collect())) == want


@pytest.mark.parametrize(("hot", "part", "batch"), [(simhash.HOT, simhash.PART, 10_000), (3, 1000, 5), (3, 4, 64), (40, 10, 64)])
def test_simhash_covering_misses_no_link(spark, hot, part, batch):
    rnd, prints = random.Random(11), []
    for _ in range(30):
        p = rnd.getrandbits(64)
        for _ in range(12):
            prints.append(p)
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                p ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot, part)
    roots = {r.node: r.root for r in components(edges).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts, mine = {}, {}
    for p, c in zip(signed, plain_components(prints), strict=True):
        parts.setdefault(c, set()).add(p)
        mine.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, mine.values()))


def test_simhash_cluster_of_30000_fingerprints(spark):
    rnd = np.random.default_rng(5)
    centre = rnd.integers(0, 1 << 63, dtype=np.uint64)
    bits = np.packbits(rnd.random((40_000, 64)) < 0.06, axis=1, bitorder="little").view(np.uint64).ravel()
    prints = np.unique(np.concatenate([centre ^ bits, rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)]))[:30_000]
    label = np.arange(len(prints))
    pairs = np.concatenate([np.stack([np.full(len(j), i), j]) for i in range(len(prints)) if len(j := np.flatnonzero(np.bitwise_count(prints[i:] ^ prints[i]) <= 3) + i)], axis=1)
    child, root = forest(pairs[1], pairs[0])
    label[child] = root
    least = np.full(len(prints), 1 << 62, np.int64)
    signed = prints.view(np.int64)
    order = np.argsort(signed, kind="stable")
    np.minimum.at(least, label, np.argsort(order))
    groups = spark.createDataFrame(pd.DataFrame({"fp": signed})).repartition(4)
    roots = {r.node: r.root for r in components(simhash.links(groups, 2000, 3000), 50_000).collect()}
    got = np.array([roots.get(p, p) for p in signed.tolist()])
    assert (got == signed[order][least[label]]).all() and len(np.unique(label)) > 100


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
def test_components_of_chains_stars_and_random_graphs(spark, chunk):
    rnd = random.Random(chunk)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(3000 - i, 3000) for i in range(1, 300)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(180)] + [(7, 7), (None, 3), (1399, 2999)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5), chunk).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {x: find(x) for x in root}


def test_near_copies_against_plain_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    rnd = random.Random(8)
    base = [w for r in rows for w in (r.text or "").split()][:400]
    variants = [tuple([10_000 + i, " ".join(w if rnd.random() > 0.01 else f"x{i}" for w in base), "en", "s", 1]) for i in range(300)]  # one large group
    rows += spark.createDataFrame(variants, DOCS).collect()

    sets = [plain_shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    want = {rows[x].doc_id for x in label}
    got = {r.doc_id for r in nearcopies.keep_one(docs.unionByName(spark.createDataFrame(variants, DOCS))).collect()}
    assert want <= got and len(got - want) <= 0.02 * (len(rows) - len(want))


def test_near_copies_split_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 64)
    monkeypatch.setattr(nearcopies, "SHARE", 2)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(1000)}" for _ in range(200)]
    rows = [(i, " ".join(w if rnd.random() > 0.005 else f"x{i}" for w in base), "en", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    assert nearcopies.keep_one(docs).count() <= 10 and nearcopies.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block", [8192, 16])
def test_near_copies_lose_no_link(spark, monkeypatch, block):
    """Chains whose neighbours are just similar enough, and frequent shingles; with small blocks every bucket is hot."""
    for module in (nearcopies, prefixes):
        monkeypatch.setattr(module, "BLOCK", block)
        monkeypatch.setattr(module, "SHARE", 1)
    monkeypatch.setattr(prefixes, "SAMPLE", 1)
    rnd, texts = random.Random(12), []
    for chain in range(4):
        words, at = [f"c{chain}w{i}" for i in range(2000)], 0
        for _ in range(100):
            texts.append(" ".join([f"top{i}" for i in range(chain * 10)] + words[at : at + 104]))
            at += rnd.choice([9, 10, 11, 12, 13])
    rnd.shuffle(texts)
    sets, label = [plain_shingles(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], DOCS)
    assert 20 < len(set(label)) < 300
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == sorted(set(label))


def test_near_copies_odd_rows(spark):
    got = nearcopies.keep_one(odd(spark))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "7", "8", "None"] and got.columns == odd(spark).columns
    same = spark.createDataFrame([(None, "a b c d e f", None, None, None)] * 3 + [(3, "A b c d e f", None, None, None), (2, "x", None, None, None), (2, "x", None, None, None)], DOCS)
    assert sorted(r.doc_id for r in nearcopies.keep_one(same).collect()) == [2, 3]
    assert nearcopies.keep_one(none(spark)).count() == 0


def test_simhash_odd_rows(spark):
    got = simhash.assign(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.assign(none(spark)).count() == 0 and components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGE = """<html><head><title>T</title></head><body class="no-sidebar"><header>Site</header><nav><a href=1>Home</a></nav><div id=cookie-notice>We use cookies</div>
<div class="layout"><div class="sidebar"><p>Side words, many of them, and more, to score well.</p></div>
<article class="post"><h1>Head &amp; title</h1><p>First   paragraph, with commas, and <b>bold</b> words that are long enough.<p>Second one,<br>with a break &lt;kept&gt;, and more words to count.
<aside>Aside</aside><form><input><button>Send</button></form><ul><li>item one<li>item two</ul><script>var a="</p>";</script><div class="ad">Buy</div><!-- x --></article>
<section id="comments"><p>Reader says something long, with commas, many, many, many.</p></section></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_main.main_text(PAGE) == "Head & title First paragraph, with commas, and bold words that are long enough. Second one, with a break <kept>, and more words to count. item one item two"
    assert html_main.main_text("<div><p>" + "word, " * 20 + "</p><p>" + "more, " * 20 + "</p></div><div class=menu><a>x</a></div>") == " ".join(["word,"] * 20 + ["more,"] * 20)
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "plain &eacute;"), (3, "u", "<<>< a='<b"), (4, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text) for r in html_main.extract(pages).collect()}
    assert {(1, ""), (2, ""), (3, "plain é"), (4, "deep")} <= got and html_main.extract(pages.limit(0)).count() == 0


LONG_WORDS = " ".join(["Some words of an article, and more of them."] * 12)
THREE = "".join(f"<p>{n} {LONG_WORDS}</p>" for n in "abc")
THREE_TEXT = " ".join(f"{n} {LONG_WORDS}" for n in "abc")
ROUND = "<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<footer>All rights reserved, and so on, by the owner of this page.</footer>"


@pytest.mark.parametrize("wrapper", [
    "<form action=x>", "<fieldset>", "<div class='layout has-sidebar'>", "<div class='page with-ads'>", "<div class='market-share-report'>", "<div class='search'>", "<div id=search-results>", "<div class=sidebar>",
    "<article class='post comments-open'>", "<article class='post tag-social'>", "<form><article>", "<section class='header'>", "<div class='discussion'>",
])
def test_html_keeps_an_article_in_a_badly_named_wrapper(wrapper):
    assert html_main.main_text(f"<html><body>{ROUND[0]}{wrapper}{THREE}</div></form>{ROUND[1]}</body></html>") == THREE_TEXT


@pytest.mark.parametrize("extra", [
    "<section id=comments>{}</section>", "<div class=comment-list>{}</div>", "<div class=related-posts>{}</div>", "<aside>{}</aside>", "<div class=cookie-notice>{}</div>", "<div class='widget newsletter-signup'>{}</div>",
    "<form>{}</form>", "<div hidden>{}</div>", "<div style='display: none'>{}</div>", "<footer>{}</footer>", "<div class=sponsored-content>{}</div>", "<noscript>{}</noscript>", "<textarea>{}</textarea>",
])
@pytest.mark.parametrize("frame", ["article", "div"])
def test_html_leaves_out_what_is_no_article(extra, frame):
    other = extra.format("<p>" + "Other words, not of the article, with commas, to score well. " * 8 + "</p>")
    assert html_main.main_text(f"<body>{ROUND[0]}<{frame}>{THREE}</{frame}>{other}{ROUND[1]}</body>") == THREE_TEXT


def test_html_long_comments_stay_out():
    short = "A short article, but an article, with some words to it, and some commas, as usual."
    comments = "".join(f"<div class=comment-body><p>Reader {i} says, at length, many, many words about it, again and again.</p></div>" for i in range(60))
    assert html_main.main_text(f"<body><article><p>{short}</p></article><div id=comments>{comments}</div></body>") == short
    assert html_main.main_text(f"<body><form><div><p>{short}</p></div></form><div id=comments>{comments}</div></body>") == short


HOSTILE = {
    "open tags": "<a" * 500_000, "open tags at last closed": "<a" * 500_000 + ">", "open quotes": "<a x=\"" * 160_000 + ">", "quoted ends": "<a b=\">\" c" * 90_000, "one quote": "<p title='>x" * 80_001,
    "stray end tags": "<p>" + "<i>" * 60_000 + "</b>" * 200_000, "blockquotes": "<blockquote>a, b" * 60_000, "cells": "<table><td>" * 80_000 + "x", "forms": "<form>x" * 130_000, "comment marks": "<!--" * 250_000, "comments": "<!-- x -->" * 100_000,
    "raw": "<script>" * 120_000, "rules": "<b>" * 100_000 + "<hr>" * 150_000, "attributes": "<p " + "a b " * 250_000 + ">text", "long name": "<p " + "a" * 1_000_000 + ">text", "spaces": "<p a" + " " * 1_000_000 + ">text", "entities": "&amp" * 250_000,
    "articles": "<article>" * 110_000, "equals": "<p " + "=\"" * 400_000 + ">text", "less": "<" * 1_000_000 + ">", "asides": "<aside>x" * 120_000 + "</aside>" * 10, "bodies": "<body>" * 160_000, "headings": "<h1>x</h1>" * 100_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_html_hostile_pages_take_linear_time(name):
    import time

    began = time.process_time()
    html_main.main_text(HOSTILE[name])
    assert time.process_time() - began < 8


def test_html_query_against_articles(spark):
    import html as h
    import re

    for r in queries.op9_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert r.text == " ".join(h.unescape(re.sub("<[^>]*>", " ", article)).split()) and r.n_chars == len(r.text)


def test_language(spark):
    found = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    sample = {"aa": "the cat sat on the mat", "bb": "el gato se sienta en la casa"}
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd(spark), sample).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and langid.predict(odd(spark), {}).filter("lang_pred != 'und'").count() == 0
    assert langid.predict(none(spark), sample).count() == 0 and langid.training_sample(none(spark)) == {}


def greedy_phrases(train, text):
    train, text = ("".join(chr(0x100 + c) for c in x) for x in (train, text))
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in train:
            n += 1
        count, at = count + 1, at + n
    return count


@pytest.mark.parametrize(("run", "batch"), [(256, 1 << 20), (4, 1 << 20), (8, 10), (3, 7)])
def test_parser_counts_greedy_phrases(monkeypatch, run, batch):
    monkeypatch.setattr(langid, "RUN", run)
    monkeypatch.setattr(langid, "BATCH_CHARS", batch)
    rnd = random.Random(6)
    parser = langid.Parser((("x", "abcab aaab cabba"), ("y", "zzz"), ("z", "".join(rnd.choice("ab c") for _ in range(300)))))
    texts = ["cabcabz", "", "a" * 50, "?!", "aab  ab\nc" * 9, *("".join(rnd.choice("abc  qz") for _ in range(rnd.randrange(90))) for _ in range(40))]
    for given in (texts, *([t] for t in texts)):
        costs, letters = parser.costs(given) if batch > 100 or len(given) == 1 else (None, None)
        if costs is None:
            continue
        for i, text in enumerate(given):
            codes = parser.codes([text])[0].tolist()
            for n, train in enumerate(("abcab aaab cabba", "zzz")):
                want = greedy_phrases(parser.codes([train])[0].tolist(), codes)
                assert letters[i] == sum(c.isalpha() for c in text)
                assert abs(costs[i, n] * max(1, letters[i]) / parser.bits[n] - want) < 1e-6


def test_parser_keeps_every_letter():
    rnd = random.Random(4)
    letters = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "en": "abcdefghijklmnopqrstuvwxyz", "ko": [chr(0xAC00 + 7 * i) for i in range(300)], "ru": [chr(0x430 + i) for i in range(32)], "zh": [chr(0x4E00 + i) for i in range(900)], "zz": [chr(0x20000 + i) for i in range(900)]}
    words = {k: ["".join(rnd.choices(x, k=rnd.randrange(2, 5))) for _ in range(200)] for k, x in letters.items()}
    texts = {k: " ".join(rnd.choices(w, k=n)) for (k, w), n in zip(words.items(), (300, 900, 200, 900, 100, 150), strict=True)}
    parser = langid.Parser(tuple(texts.items()))
    costs, _ = parser.costs([" ".join(t.split()[20:60]) for t in texts.values()])
    assert [parser.names[i] for i in costs.argmin(axis=1)] == list(texts)
    text = " ".join(rnd.choices(texts["zh"].split(), k=40))
    got, n_letters = parser.costs([text])
    assert abs(got[0, 4] * n_letters[0] / parser.bits[4] - greedy_phrases(*(parser.codes([x])[0].tolist() for x in (texts["zh"], text)))) < 1e-6


def test_language_query_against_plain_parse(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = langid.training_sample(docs)
    parser = langid.Parser(tuple(sorted(samples.items())))
    rows = [r for r in docs.collect() if r.doc_id % 25 == 0 and len(r.text or "") < 3000]
    got = {r.doc_id: r.lang_pred for r in queries.op10_language_id(spark, SF).collect()}
    for r in rows:
        codes = parser.codes([r.text or ""])[0].tolist()
        bits = [greedy_phrases(parser.codes([t])[0].tolist(), codes) * b for (_, t), b in zip(sorted(samples.items()), parser.bits, strict=True)] if any(c.isalpha() for c in r.text or "") else None
        assert got[r.doc_id] == ("und" if bits is None else parser.names[int(np.argmin(bits))])


@pytest.mark.parametrize("tiny", [None, "ok", "twenty letters in here"])
def test_language_with_hardly_any_text_does_not_win(spark, tiny):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_language = spark.createDataFrame([(100_000 + i, tiny, "xx", "s", 1) for i in range(40)], DOCS)
    samples = langid.training_sample(docs.unionByName(odd_language))
    assert ("xx" in samples) == (tiny is not None)
    found = langid.predict(docs, samples, keep=("doc_id", "lang")).filter("lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_language_sample_takes_whole_short_documents_or_the_middle_of_a_long_one(spark):
    rows = [(i, f"kurz {i} " * 300 if i % 2 else "lang " * 3000, "de", "s", 1) for i in range(40)] + [(100 + i, "x" * 100 + "longue " * 9000 + "y" * 100, "fr", "s", 1) for i in range(9)]
    got = langid.training_sample(spark.createDataFrame(rows, DOCS))
    assert "lang" not in got["de"] and len(got["de"]) > 2000 and len(got["fr"]) == langid.SAMPLE_LETTERS and set(got["fr"]) == set("longue ")


def plain_shingles(text):
    words = __import__("re").findall("[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_against_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i for i, r in docs.items() if r.text and any(c.isalpha() for c in r.text)}
    judged = {r.doc_id for r in queries.op6_quality_rules(spark, SF).filter("kept").collect()}
    kept &= judged
    groups = {}
    for i in kept:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in docs[i].text), []).append(i)
    kept = sorted(max(g) for g in groups.values())
    sets, label = [plain_shingles(docs[i].text) for i in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if label[i] != label[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    want = {kept[c] for c in label}
    assert len(want) < len(kept)
    got = corpus_pipeline.run(spark, SF).collect()
    coder = Tokenizer.from_file(PATH)
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(coder.encode(docs[i].text, add_special_tokens=False).ids) + 1 for i in want}
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_stages_on_odd_and_empty_tables(spark):
    for frame in (odd(spark), none(spark)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, frame, SF)
            assert out.columns == frame.columns
            out.count()
