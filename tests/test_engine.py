import json
import os
import random
import re
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark import cli, registry, staging
from docspark.functions import normalize as N
from docspark.functions import textfeat as T
from docspark.operators import bench, cache, chunking, cost, diagnose, layout, pagefold, prompts, retrieval
from docspark.plans import ingest, process
from docspark.sources import files
from docspark.streaming import jobs

SF = "/root/testdata/sf0.001"
STATS = dict(char_count=800, readable_char_count=700, persian_char_count=600, pua_char_count=0, replacement_char_count=0, control_char_count=0, image_count=0, image_area_ratio=0.0, drawing_count=2)


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr).first()[0]


def rows(frame):
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("change", "status"), [
    ({}, "text_ok"), ({"image_count": 1, "image_area_ratio": 0.5}, "text_plus_visual"), ({"pua_char_count": 200, "char_count": 1000}, "text_broken"),
    ({"replacement_char_count": 150, "char_count": 1000}, "text_broken"), ({"char_count": 5, "readable_char_count": 3, "persian_char_count": 0, "image_count": 1, "image_area_ratio": 0.95}, "scanned"),
    ({"char_count": 0, "drawing_count": 0}, "empty"), ({"persian_char_count": 10}, "text_ok"), ({"drawing_count": 5}, "text_ok"), ({"drawing_count": 50}, "text_plus_visual"), ({"char_count": 0, "drawing_count": 1}, "scanned"),
])
def test_status(spark, change, status):
    got = diagnose.diagnose_pages(spark.createDataFrame(pd.DataFrame([STATS | change]))).first()
    assert (got.status, got.method) == (status, diagnose.METHODS[status])


@pytest.mark.parametrize("name", ["pages_with_status", "text_fallback"])
def test_filters_by_status_read_each_text_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp") <= 5  # the five statistics


def test_counts_of_characters(spark):
    text = "a1\n ۱ ب\u200c\U0001d49c\U00020000\ufffd\ue001\x01،"
    got = diagnose.text_stats(spark.createDataFrame([(text,), ("",), (None,)], "text string")).collect()
    assert tuple(got[0])[1:] == (14, 10, 3, 1, 1, 1)
    assert [tuple(r)[1:] for r in got[1:]] == [(0,) * 6] * 2


def test_text_fallback_of_equal_page_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(6, "a b " * 20, "en", "s", 80), (6, "c d " * 25, "en", "t", 100), (7, "e f " * 60, "en", "s", 240)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.text_fallback(spark, str(tmp_path)).collect())) == [("s", 6), ("t", 6)]


@pytest.mark.parametrize(("given", "wanted"), [
    ("كتاب", "کتاب"), ("يك", "یک"), ("ؤةأ", "وها"), ("۱۲۳", "123"), ("٠١٢", "012"), ("می‌روم", "می‌روم"), ("سلام    دنیا", "سلام دنیا"),
    ("کِتَاب", "کتاب"), ("نیک، خوب", "نیک, خوب"), ("سلام !", "سلام!"), ("سلام ؟", "سلام ?"), ("ﺍﻣ"[:1] + "ﻣ", "ام"), ("", ""), ("Å", "Å"),
])
def test_normalize(spark, given, wanted):
    assert one(spark, N.normalize_text(F.col("x")), x=given) == wanted


def test_normalize_keeps_nfc(spark):
    text = unicodedata.normalize("NFD", "éàü")
    assert one(spark, N.normalize_text(F.col("x")), x=text) == "éàü"


def test_parse_pages(spark):
    assert one(spark, T.parse_pages(F.col("x")), x="1,2,5-9,2") == [1, 2, 5, 6, 7, 8, 9]
    assert one(spark, T.parse_pages(F.col("x")), x=" ") is None


def test_token_estimate_rounds_half_even(spark):
    assert one(spark, T.estimate_tokens(F.col("x")), x="a" * 8) == 2
    assert one(spark, T.estimate_tokens(F.col("x")), x="") == 0


def test_costs_round_exact_halves_up(spark):
    asked = spark.createDataFrame([(560,), (1480,), (720,)], "context int")
    got = cost.scenario(asked, F.col("context"), F.lit(20), F.lit(350)).collect()
    assert [(r.total_cost_usd, r.total_cost_toman) for r in got] == [(0.005, 1138), (0.0073, 1668), (0.0054, 1230)]
    used = asked.select(bench.usage(F.col("context"), F.lit(20), 350).alias("u")).select("u.*").collect()
    assert [(r.total_cost_usd, r.total_cost_toman) for r in used] == [(0.005, 1138), (0.0073, 1668), (0.0054, 1230)]


def test_split_and_merge():
    assert chunking.split_paragraph("short") == ["short"]
    long = "word " * 400
    pieces = chunking.split_paragraph(long.strip(), 100)
    assert "".join(pieces).replace(" ", "") == long.replace(" ", "")
    assert chunking.merge_small(["a" * 10, "b" * 10, "c" * 100]) == ["a" * 10 + " " + "b" * 10 + " " + "c" * 100]


def lines_by_fold(blocks):
    made = []
    for b in sorted(blocks, key=lambda b: (b[2], b[1], b[0])):
        best, at = 0.0, None
        for k, line in enumerate(made):
            last = line[-1]
            shared, low = min(last[4], b[4]) - max(last[2], b[2]), min(last[4] - last[2], b[4] - b[2])
            if shared >= 0.5 * low and shared > best:
                best, at = shared, k
        made.append([b]) if at is None else made[at].append(b)
    return sorted(sorted(b[0] for b in line) for line in made)


def test_group_lines_against_plain_fold(spark):
    rnd = random.Random(3)
    blocks = [(f"d{d}", 1, i, str(i), 0.9, float(x := rnd.randrange(500)), float(t := rnd.randrange(60)), float(x + 40), float(t + rnd.randrange(0, 15))) for d in range(20) for i in range(14)]
    got = layout.group_lines(spark.createDataFrame(blocks, files.BLOCKS)).groupBy("document_id").agg(F.collect_list("text").alias("t")).collect()
    for r in got:
        want = lines_by_fold([(b[2], b[5], b[6], b[7], b[8]) for b in blocks if b[0] == r.document_id])
        assert sorted(sorted(map(int, t.split())) for t in r.t) == want


def regions(*items):
    return [("d", page, i, role, text, 0.0, 0.0, 1.0, 1.0, 0.9, "text") for i, (page, role, text) in enumerate(items)]


def chunked(spark, items, **options):
    names = ["document_id", "page_number", "region_idx", "role", "text", "l", "t", "r", "b", "score", "source_method"]
    return chunking.chunk_regions(spark.createDataFrame(regions(*items), names), **options).orderBy("chunk_index").collect()


def test_chunk_regions(spark):
    body = "متن " * 60
    got = chunked(spark, [(1, "heading", "فصل"), (1, "body", body.strip()), (1, "special", "H2O"), (2, "body", body.strip())])
    assert [(c.chunk_type, c.section, c.page_start) for c in got] == [("paragraph", "فصل", 1), ("paragraph", None, 2)]
    assert got[0].text.endswith("H2O") and got[0].chunk_id == "d-c0000"
    merged = chunked(spark, [(1, "body", body.strip()), (2, "body", body.strip())], merge_across_pages=True)
    assert [(c.page_start, c.page_end) for c in merged] == [(1, 2)]


def plain_split(text, limit):
    """The contract of paragraph splitting, sentence by sentence."""
    if len(text) <= limit:
        return [text]
    out, open_ = [], ""
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.?!؟…])\s+|\n", text))):
        while len(s) > limit:
            at = next((k for k in (s.rfind("،", 0, limit), s.rfind(" ", 0, limit)) if k >= limit // 2), limit)
            out.append(open_ + s[:at].strip())
            open_, s = "", s[at:].strip()
        if s and open_ and len(open_) + 1 + len(s) > limit:
            out.append(open_)
            open_ = s
        elif s:
            open_ = f"{open_} {s}".strip()
    return out + [open_] * bool(open_)


def plain_chunks(regions, merge=False, reset=True, least=80, limit=900):
    """(type, text, page_start, page_end, section, score) of one document's regions in order, by the rules of chunking."""
    out, path, state = [], [], {"section": None, "heading": None, "buffer": [], "held": [], "page": None}

    def emit(kind, group, section):
        merged = []
        for piece in plain_split(" ".join(r.text for r in group), limit):
            if merged and len(merged[-1]) < least and len(merged[-1]) + 1 + len(piece) <= limit:
                merged[-1] += " " + piece
            else:
                merged.append(piece)
        out.extend((kind, t, group[0].page_number, group[-1].page_number, section, round(sum(r.score for r in group) / len(group), 4)) for t in merged)

    def specials():
        if state["held"]:
            group, state["held"] = state["held"], []
            emit("special", group, state["section"])

    def flush():
        group, state["buffer"] = state["buffer"], []
        if group:
            emit("special" if all(r.text.isascii() for r in group) else "paragraph", group, state["section"] or (state["heading"].text if state["heading"] else None))
            state["heading"] = None
            specials()
        elif state["heading"]:
            head, state["heading"] = state["heading"], None
            emit("heading", [head], state["section"])

    for r in regions:
        used = sum(len(x.text) for x in state["buffer"])
        if state["page"] not in (None, r.page_number) and not merge:
            flush()
            used = 0
            if reset:
                path.clear()
                state.update(section=None, heading=None)
        state["page"] = r.page_number
        if r.role == "heading":
            flush()
            path[:] = path[: path.index(r.text) + 1] if r.text in path else [*path, r.text][-3:]
            state.update(section=r.text, heading=r)
        elif r.role == "special":
            if state["buffer"] and used + len(r.text) + 1 <= limit and state["buffer"][-1].source_method == r.source_method:
                state["buffer"].append(r)
            else:
                flush()
                state["held"].append(r)
        else:
            if state["buffer"] and used + len(r.text) + 1 > limit:
                flush()
            state["buffer"].append(r)
            if sum(len(x.text) for x in state["buffer"]) >= limit:
                flush()
    specials()
    flush()
    return out


def test_split_against_plain_version():
    rnd = random.Random(1)
    for _ in range(3000):
        text, limit = "".join(rnd.choice("ab،  .!\n\t\xa0c") for _ in range(rnd.randrange(90))), rnd.randrange(4, 30)
        assert chunking.split_paragraph(text, limit) == plain_split(text, limit)


@pytest.fixture(scope="module")
def sf_regions(spark):
    return spark.createDataFrame(registry.regions(spark, SF).withColumn("source_method", F.lit("text")).collect())


@pytest.mark.parametrize(("merge", "reset"), [(False, True), (True, True), (False, False)])
def test_chunk_regions_against_plain_version(spark, sf_regions, merge, reset):
    by_document = {}
    for r in sorted(sf_regions.collect(), key=lambda r: (r.document_id, r.page_number, r.region_idx)):
        by_document.setdefault(r.document_id, []).append(r)
    got = {}
    for r in sorted(chunking.chunk_regions(sf_regions, merge, reset).collect(), key=lambda r: (r.document_id, r.chunk_index)):
        assert r.chunk_id == f"{r.document_id}-c{len(got.get(r.document_id, [])):04d}" and r.char_count == len(r.text)
        got.setdefault(r.document_id, []).append((r.chunk_type, r.text, r.page_start, r.page_end, r.section, round(r.score, 4)))
    assert got == {d: plain_chunks(rs, merge, reset) for d, rs in by_document.items()}
    if not merge and reset:
        want = {f"{d}-c{i:04d}": c for d, cs in got.items() for i, c in enumerate(cs)}
        query = {r.chunk_id: r for r in registry.chunk_regions(spark, SF).collect()}
        assert {k: (r.chunk_type, r.text, r.page_start, r.page_end, r.section) for k, r in query.items()} == {k: c[:-1] for k, c in want.items()}
        assert all(abs(r.score - want[k][-1]) < 2e-4 for k, r in query.items())


def test_chunk_pages_query_against_plain_version(spark, sf_regions):
    want, numbers = {}, {}
    pages = {}
    for r in sorted(sf_regions.collect(), key=lambda r: (r.document_id, r.page_number, r.region_idx)):
        pages.setdefault((r.document_id, r.page_number), []).append(r)
    for (d, _), rs in pages.items():
        for c in plain_chunks(rs):
            want[f"{d}-c{numbers.get(d, 0):04d}"] = c[:4]
            numbers[d] = numbers.get(d, 0) + 1
    got = {r.chunk_id: (r.chunk_type, r.text, r.page_start, r.page_end) for r in registry.chunk_pages(spark, SF).collect()}
    assert got == want


@pytest.fixture(scope="module")
def odd_blocks(spark):
    """Blocks of the test table and of pages made to meet every rule: all kinds of words, boxes that overlap, one long page."""
    draw = random.Random(5)
    parts = ["the", "of", "a", "1", "25%", "(12)", "H2O", "+", "Na2", "=", "O", "o", "۰", "°", "دارد", "می‌شود", "شود", "کتاب", "ﺍﻣ", "كِتَاب", "،", ":", "ab.", "١٢", "دانلود از", "é", "é", "\U0010ffff", "\U0001d7ce", " ", "\x1c", "\t", "\xa0\xa0", "©", "中文", "word", "another"]
    made = []
    for page in range(60):
        for i in range(900 if page == 0 else draw.randrange(1, 40)):
            text = draw.choice(["", " "]) + draw.choice([" ", "  ", "\n", ""]).join(draw.choices(parts, k=draw.choice((0, 1, 1, 2, 3, 5, 9)))) + draw.choice(["", "", " ", "\n"])
            left, top = draw.randrange(0, 500) / 1.0, draw.randrange(0, 800) / 2.0
            made.append((f"x{page % 7}", page, i, text, draw.randrange(20, 101) / 100, left, top, left + draw.randrange(5, 300), top + draw.randrange(4, 30)))
    return registry.blocks(spark, SF).unionByName(spark.createDataFrame(made, registry.blocks(spark, SF).schema)).localCheckpoint()


@pytest.mark.parametrize("source", [None, "text", "ocr"])
def test_fold_equals_the_rules_step_by_step(spark, odd_blocks, source):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # pages go on from batch to batch
    blocks = odd_blocks
    if source:
        blocks = layout.filter_blocks(blocks.withColumn("text" if source == "text" else "clean", N.normalize_text(F.col("text"))))
    lines = layout.classify_lines(layout.reading_order(layout.group_lines(blocks), 595.0), 842.0)
    regions = layout.annotate_headings(layout.build_regions(lines))
    wanted = {"lines": lines, "regions": regions}
    for want in ("lines", "regions"):
        got = pagefold.fold(odd_blocks, 595.0, 842.0, want, noise=bool(source), source=source)
        assert dict(got.dtypes) == dict(wanted[want].dtypes)
        assert rows(got.toPandas()) == rows(wanted[want].toPandas())
    every = pagefold.fold(odd_blocks, 595.0, 842.0, "all", noise=bool(source), source=source).localCheckpoint()
    assert rows(every.filter("kind = 'line'").select(*lines.columns).toPandas()) == rows(lines.toPandas())
    assert rows(every.filter("kind = 'region'").select(*regions.columns).toPandas()) == rows(regions.toPandas())
    assert rows(every.filter("kind = 'page'").select("document_id", "page_number", "text").toPandas()) == rows(process.page_text(regions).toPandas())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["process_pages", "ingest_job"])
def test_whole_runs_make_blocks_once_and_fold_pages_twice(spark, monkeypatch, name):
    staged, folded = [], []
    monkeypatch.setattr(registry, "stage", lambda df, name: staged.append(name) or staging.stage(df, name))
    monkeypatch.setattr(process, "fold", lambda *a, source, **b: folded.append(source) or pagefold.fold(*a, source=source, **b))
    registry.queries()[name](spark, SF)
    assert (staged, folded) == (["blocks"], ["text", "ocr"])


def test_only_pages_with_repeated_lines_are_made_again(spark, monkeypatch):
    rows_, made, ocr = registry._run_inputs(spark, SF)
    seen = []
    monkeypatch.setattr(process, "stripped_regions", lambda lines, gone: seen.append((lines, gone)) or layout.stripped_regions(lines, gone))
    process.run_pipeline(rows_, made, 595.0, 842.0, ocr)
    [(lines, gone)] = seen
    hit = layout.with_texts(lines.filter("region_idx IS NOT NULL"), gone, "clean").select("document_id", "page_number").distinct()
    assert hit.count() == lines.select("document_id", "page_number").distinct().count() < made.select("document_id", "page_number").distinct().count()


def test_repeated_texts_of_equal_digests_are_told_apart(spark, monkeypatch):
    used = []
    monkeypatch.setattr(layout.F, "xxhash64", lambda *c: used.append(c) or F.lit(7).cast("long"))
    lines = spark.createDataFrame([("d", p, x) for p in range(5) for x in ("\x85same\u2003", f"only {p}", "ab ", "", None)] + [("e", p, "same") for p in range(3)], "document_id string, page_number int, text string")
    assert sorted(map(tuple, layout.repeated_texts(lines).collect())) == [("d", "same")]
    assert len(used) == 2
    assert layout.strip_repeated(lines).count() == 23


def test_fold_of_pages_without_regions(spark):
    noise = spark.createDataFrame([("d", 1, 0, "o O", 0.9, 1.0, 1.0, 5.0, 5.0), ("d", 2, 0, "", 0.9, 1.0, 1.0, 5.0, 5.0)], registry.blocks(spark, SF).schema)
    for filtered in (False, True):
        got = pagefold.fold(noise, 595.0, 842.0, "all", noise=filtered).collect()
        assert [(r.kind, r.line_type) for r in got] == [("line", "noise")] * (0 if filtered else 2)
        assert pagefold.fold(noise, 595.0, 842.0, "regions", noise=filtered).collect() == []


def test_filter_in_one_pass_equals_the_rules(spark, odd_blocks):
    more = spark.createDataFrame([("y", 1, 0, None, 0.9, 0.0, 0.0, 1.0, 1.0), ("y", 1, 1, "some words", None, 0.0, 0.0, 1.0, 1.0), ("y", 1, 2, "some words", float("nan"), 0.0, 0.0, 1.0, 1.0)], odd_blocks.schema)
    given = odd_blocks.unionByName(more)
    assert rows(pagefold.filter_blocks(given).toPandas()) == rows(layout.filter_blocks(given).toPandas())


@pytest.mark.parametrize("name", ["chunk_pages", "chunk_regions", "line_types", "noise_block_filter", "page_text", "regions"])
def test_pages_are_laid_out_in_one_pass(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(document_id") <= {"line_types": 1, "noise_block_filter": 0, "regions": 1}.get(name, 3)
    assert "mapInArrow" in plan or "MapInArrow" in plan


def test_chunk_bodiless_heading_and_special(spark):
    got = chunked(spark, [(1, "heading", "alef"), (1, "heading", "be"), (1, "special", "x" * 20)])
    assert [c.chunk_type for c in got] == ["heading", "heading", "special"]


def test_pack_context_keeps_first(spark):
    frame = spark.createDataFrame([("q", i, "x" * 500) for i in range(10)], "q string, i int, rendered string")
    assert prompts.packed_prefix(frame, "q", ["i"], budget=800).count() == 1
    assert prompts.packed_prefix(frame, "q", ["i"], budget=10).count() == 1


def test_messages_reject_unknown_mode():
    with pytest.raises(ValueError, match="study_mode"):
        prompts.build_messages(F, F, F, "chat")


def test_cache_identity(spark, tmp_path):
    pages = spark.createDataFrame([("doc", 1, "t", "aaa", 200, "text")], "document_id string, page_no int, text string, checksum_sha256 string, dpi int, source_method string")
    store = cache.PageCache(spark, str(tmp_path / "cache"))
    store.upsert(pages)
    store.upsert(pages.withColumn("text", F.lit("newer")))
    asked = pages.withColumn("engine_version", F.lit(chunking.ENGINE_VERSION)).drop("text")
    assert cache.lookup(asked, store.read()).first().cached_text == "newer"
    for name, value in (("checksum_sha256", "bbb"), ("dpi", 300), ("source_method", "ocr")):
        assert not cache.lookup(asked.withColumn(name, F.lit(value)), store.read()).first().cache_hit
    assert cache.misses(asked, store.read()).count() == 0


def test_stream_equals_batch_and_skips_cached(spark, tmp_path):
    kinds = "document_id string, page_no int, text string, checksum_sha256 string, dpi int, source_method string"
    src, sink, store = str(tmp_path / "in"), str(tmp_path / "out"), cache.PageCache(spark, str(tmp_path / "cache"))

    def drive(pages):
        spark.createDataFrame(pages, kinds).withColumn("engine_version", F.lit(chunking.ENGINE_VERSION)).write.mode("append").parquet(src)
        jobs.run_jobs(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), store, lambda p: p.withColumn("n", F.length("text")), sink, str(tmp_path / "cp")).awaitTermination()

    drive([("d", 1, "abc", "s", 200, "text"), ("d", 2, "x", "s", 200, "text")])
    drive([("d", 1, "abc", "s", 200, "text"), ("d", 3, "yy", "s", 200, "text")])
    assert sorted((r.page_no, r.n) for r in spark.read.parquet(sink).collect()) == [(1, 3), (2, 1), (3, 2)]


def test_ingest_ocr_branch_and_sinks(spark, tmp_path):
    routed = spark.createDataFrame([("d", 1, "text"), ("d", 2, "ocr")], "document_id string, page_number int, route string")
    line = "متن فارسی بلند برای آزمون که چند واژه دارد"
    blocks = spark.createDataFrame([("d", 1, 0, line, 1.0, 0.0, 10.0, 400.0, 20.0)], files.BLOCKS)
    found = ingest.ingest(routed, blocks, 595.0, 842.0, lambda p: files.ocr_blocks(p.withColumn("image", F.lit(b"img")), lambda: lambda image: [(line, 0.9, 0.0, 10.0, 400.0, 20.0)]))
    assert sorted((r.page_number, r.source_method) for r in found.collect()) == [(1, "text"), (2, "ocr")]
    made = ingest.chunk_pages(found)
    files.write_chunks(made, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == made.count() == 2
    assert files.document_text(found).first().value.startswith("# d\n\n--- page 1 (text) ---\n")


def test_text_layer_blocks(spark):
    page = '{"document_id":"d","page_number":1,"blocks":[{"type":0,"bbox":[0,0,9,9],"lines":[{"bbox":null,"spans":[{"text":"يك"},{"text":" دو "}]},{"bbox":[1,1,2,2],"spans":[{"text":"  "}]}]},{"type":1,"bbox":[0,0,1,1],"lines":[]}]}'
    kind = "document_id string, page_number int, blocks array<struct<type:int,bbox:array<double>,lines:array<struct<bbox:array<double>,spans:array<struct<text:string>>>>>>"
    got = files.text_blocks(spark.createDataFrame([(page,)], "v string").select(F.from_json("v", kind).alias("p")).select("p.*")).collect()
    assert [(r.text, r.l, r.r) for r in got] == [("یک دو", 0.0, 9.0)]
    many = spark.range(1).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.struct(F.lit(0).alias("type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.array(F.struct(F.lit(None).cast("array<double>").alias("bbox"), F.array(F.struct(i.cast("string").alias("text"))).alias("spans"))).alias("lines"))).alias("blocks"))
    assert files.text_blocks(many).agg(F.max("block_idx"), F.count("*")).first() == (29_999, 30_000)


LINE = "متن فارسی بلند برای آزمون که چند واژه دارد"
IDENTITY = "document_id string, page_number int, checksum_sha256 string, status string, method string"


def test_run_pages_serves_cache_text_fallback_and_ocr(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "s", "text_ok", "text_extract_sorted"), ("d", 2, "s", "scanned", "ocr"), ("d", 3, "s", "empty", "skip"), ("d", 4, "s", "text_ok", "text_extract_sorted"), ("d", 5, "s", "text_ok", "text_extract_sorted")], IDENTITY)
    blocks = spark.createDataFrame([("d", n, 0, LINE, 1.0, 0.0, 10.0, 400.0, 20.0) for n in (1, 5)], files.BLOCKS)
    seen = lambda todo: files.ocr_blocks(todo.withColumn("image", F.lit(b"img")), lambda: lambda image: [(LINE, 0.9, 0.0, 10.0, 400.0, 20.0)])
    store = cache.PageCache(spark, str(tmp_path / "cache"))
    store.upsert(spark.createDataFrame([("d", 5, "cached", "s", 200, "text"), ("d", 1, "old", "other", 200, "text")], "document_id string, page_no int, text string, checksum_sha256 string, dpi int, source_method string"))
    done = process.run_pages(pages, blocks, 595.0, 842.0, store.read(), seen)
    got = {r.page_number: (r.source_method, r.cache_hit, r.fallback_used, r.text) for r in done.pages.collect()}
    assert got == {1: ("text", False, False, LINE), 2: ("ocr", False, False, LINE), 3: ("ocr", False, False, ""), 4: ("ocr", False, False, LINE), 5: ("text", True, False, "cached")}
    assert sorted(r.page_no for r in process.cache_rows(done, pages).collect()) == [1, 2, 4]
    store.upsert(process.cache_rows(done, pages))
    again = process.run_pages(pages, blocks, 595.0, 842.0, store.read(), seen)
    assert {r.page_number for r in again.pages.filter("cache_hit").collect()} == {1, 2, 5}  # a page that fell back is stored as OCR and routed to text, so it is done again
    fixed = process.run_pages(pages, blocks, 595.0, 842.0, store.read(), seen, ingest.Options(fix_fallback=True))
    assert {r.page_number for r in fixed.pages.filter("cache_hit").collect()} == {1, 2, 4, 5}
    first = process.run_pages(pages, blocks, 595.0, 842.0, None, seen, ingest.Options(fix_fallback=True))
    assert [r.page_number for r in first.pages.filter("fallback_used").collect()] == [4]
    whole = process.documents(done, process.document_chunks(done)).first()
    assert len(whole.pages) == 5 and whole.method_per_page["4"] == "ocr" and len(whole.chunks) == 3
    none = process.run_pages(pages.limit(0), blocks, 595.0, 842.0, None, seen)
    assert none.pages.count() == 0 and process.job_chunks(none).count() == 0
    assert {r.page_number for r in process.run_document(pages, blocks, 595.0, 842.0, seen, ingest.Options(mode="ocr_only")).pages.collect()} == {1, 2, 4, 5}
    assert {r.page_number for r in process.run_pages(pages, blocks, 595.0, 842.0, options=ingest.Options(mode="ocr_only"), ocr=seen).pages.filter("source_method = 'ocr'").collect()} == {1, 2, 3, 4, 5}


def test_run_job(spark):
    pages = spark.createDataFrame([("d", n, "s", "text_ok", "text_extract_sorted") for n in (1, 2, 3)] + [("e", 1, "s", "text_ok", "text_extract_sorted")], IDENTITY)
    blocks = spark.createDataFrame([(d, n, 0, f"{LINE} {n}0000", 1.0, 0.0, 10.0, 400.0, 20.0) for d in "de" for n in (1, 2, 3)], files.BLOCKS)
    for asked, want in (((2, 3, 2), [2, 3]), ((), [1, 2, 3]), ((9,), [1, 2, 3])):
        run, chunks, rollup = process.run_job(process.Job("d", asked), pages, blocks, 595.0, 842.0)
        assert sorted((r.document_id, r.page_number) for r in run.pages.collect()) == [("d", n) for n in want]
        assert [(r.chunk_id, r.page_start) for r in chunks.orderBy("chunk_index").collect()] == [(f"d-c{i:04d}", n) for i, n in enumerate(want)]
        r = rollup.first()
        assert (r.pages_done, r.chunk_count, r.method_per_page, r.status_per_page) == (len(want), len(want), {n: "text" for n in want}, {n: "text_ok" for n in want})
    ocr = process.run_job(process.Job("d", mode="ocr_only"), pages, blocks, 595.0, 842.0, ocr=lambda todo: blocks.join(todo, ["document_id", "page_number"], "left_semi"))
    assert {r.source_method for r in ocr[0].pages.collect()} == {"ocr"}


def test_run_pipeline_strips_repeated_lines(spark):
    n_pages = 5
    pages = spark.createDataFrame([("d", n, "s", "text_ok", "text_extract_sorted") for n in range(1, n_pages + 1)], IDENTITY)
    rows = [("d", n, i, text, 1.0, 0.0, 20.0 + 14 * i, 400.0, 32.0 + 14 * i) for n in range(1, n_pages + 1) for i, text in enumerate((f"{LINE} {'الف' * n}", "سرصفحه کتاب شیمی و فیزیک دبیرستان برای همه", f"پایان {LINE} {'ب' * n}"))]
    blocks = spark.createDataFrame(rows, files.BLOCKS)
    done = process.run_pipeline(pages, blocks, 595.0, 842.0)
    run, chunks = done.run, done.chunks
    assert [tuple(r) for r in done.repeated.collect()] == [("d", "سرصفحه کتاب شیمی و فیزیک دبیرستان برای همه")]
    assert {r.page_number: r.text for r in run.pages.collect()} == {n: f"{LINE} {'الف' * n} پایان {LINE} {'ب' * n}" for n in range(1, n_pages + 1)}
    assert all("سرصفحه" not in c.text for c in chunks.collect()) and chunks.count() == n_pages
    kept = process.run_pipeline(pages, blocks, 595.0, 842.0, options=ingest.PipelineConfig(strip_repeated=False).to_options()).run
    assert all("سرصفحه" in r.text for r in kept.pages.collect())
    few = process.run_pipeline(pages.filter("page_number < 4"), blocks.filter("page_number < 4"), 595.0, 842.0).run
    assert all("سرصفحه" in r.text for r in few.pages.collect())


def test_ocr_engine_is_built_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda image: [(LINE, 0.9, 0.0, 10.0, 400.0, 20.0)]

    images = spark.range(64).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("page_number"), F.lit(b"x").alias("image"))
    for parts in (16, 8):
        assert files.ocr_blocks(images.repartition(parts), factory).count() == 64
    built = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(built) == len(set(built)) < 16


def test_footer_marks_of_a_caller(spark):
    text = F.lit("یادداشت از نشر نمونه")
    assert not spark.range(1).select(T.looks_like_footer(text)).first()[0]
    assert spark.range(1).select(T.looks_like_footer(text, (*T.FOOTER_MARKS, "نشرنمونه"))).first()[0]
    assert spark.range(1).select(T.looks_like_footer(F.lit("دريافت اپلكيشن"))).first()[0]
    blocks = spark.createDataFrame([("d", 1, 0, LINE, 1.0, 0.0, 10.0, 400.0, 20.0), ("d", 1, 1, "یادداشت از نشر نمونه", 1.0, 0.0, 30.0, 400.0, 40.0)], files.BLOCKS)
    found = ingest.page_layout(blocks, 595.0, 842.0, "text", ingest.Options(footer_marks=("نشرنمونه",)))
    assert [r.text for r in found.collect()] == [LINE]


@pytest.mark.parametrize(("ending", "kind"), [*((t, "body") for t in layout.SENTENCE_TAILS), ("میشود", "body"), ("مى شود ", "body"), ("مي باشند", "heading"), ("می\u200cگردد", "heading"), ("کتاب", "heading")])
def test_sentence_tails_are_body(spark, ending, kind):
    lines = spark.createDataFrame([("d", 1, 1, f"واژه دیگر {ending}", 100.0, 10.0, 200.0, 22.0, 0.9, 0.9, 1), ("d", 1, 2, LINE, 100.0, 40.0, 500.0, 52.0, 0.9, 0.9, 2)], "document_id string, page_number int, line_id int, text string, l double, t double, r double, b double, min_score double, mean_score double, position int")
    assert layout.classify_lines(lines, 842.0).filter("line_id = 1").first().line_type == kind


def test_search_tasks_are_bounded(spark, monkeypatch):
    """Partitions of both joins grow with the terms, whatever the session's number of partitions; results stay."""
    args = registry.chunks(spark, SF), registry.questions(spark, SF)
    want = rows(retrieval.search(*args).toPandas())
    used = []
    monkeypatch.setattr(type(args[0]), "repartition", lambda self, *a, whole=type(args[0]).repartition: used.append(a) or whole(self, *a))
    monkeypatch.setattr(retrieval, "TASK_ROWS", 500, raising=False)
    monkeypatch.setattr(retrieval, "TASK_CHUNKS", 20, raising=False)
    assert rows(retrieval.search(*args).toPandas()) == want
    assert len(used) == 2 and used[0] == (11, "chunk_id") and used[1][0] > 11


@pytest.mark.parametrize("name", ["bench_summary", "question_bench"])
def test_benchmarks_do_not_sort_chunks(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [chunk_id" in plan


@pytest.mark.parametrize("size", [5, 1_000_000])
def test_tokens_of_odd_texts(spark, monkeypatch, size):
    monkeypatch.setattr(retrieval, "TEXT_CHARS", size, raising=False)
    texts = [(1, "aa b\u2003aa\x1cكتاب ,cc"), (2, None), (3, ""), (1, "aa"), (None, "dd dd"), (4, "\U0010ffffe ff"), (5, "é" * 3 + " e\u0301e\u0301\u0301")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    plain = chunks.select("chunk_id", F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))
    assert rows(retrieval.term_frequencies(chunks).toPandas()) == rows(plain.toPandas())
    assert "Generate" not in retrieval.term_frequencies(chunks)._jdf.queryExecution().executedPlan().toString()


def test_search_by_broadcast_and_by_shuffle_agree(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} common text {i}") for i in range(200)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "word3 word4"), (2, "common text"), (3, "nothing here"), (4, "word1 word1 42")], "query_id long, question string")
    want = sorted(map(tuple, retrieval.search(chunks, queries).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, retrieval.search(chunks, queries).collect())) == want and len(want) == 12


def test_page_objects_of_folders_and_selections(spark, tmp_path):
    rows = [{"document_id": d, "page_number": n, "text_blocks": [f" {d}{n} ", " ", "يك"], "blocks": []} for d, most in (("a", 5), ("b", 1)) for n in range(1, most + 1)]
    for i, r in enumerate(rows):
        (tmp_path / f"{i}.jsonl").write_text(json.dumps(r) + "\n")
    for path in (str(tmp_path), f"{tmp_path}/*.jsonl"):
        assert sorted((r.document_id, r.page_number) for r in files.page_objects(spark, path, [2, 4]).collect()) == [("a", 2), ("a", 4), ("b", 1)]
    objects = files.page_objects(spark, str(tmp_path))
    objects.write.parquet(str(tmp_path / "p"))
    assert files.page_objects(spark, str(tmp_path / "p"), [7]).count() == 6
    assert sorted(r.text for r in files.plain_page_text(objects.filter("document_id = 'a' AND page_number < 3")).collect()) == ["a1\n\nیک", "a2\n\nیک"]


def test_records_are_read_back(spark, tmp_path):
    made = chunked(spark, [(1, "body", "متن " * 40)])
    files.write_chunks(spark.createDataFrame(made, chunking.COLUMNS), str(tmp_path / "c"))
    assert files.read_json(spark, str(tmp_path / "c"), "chunk").select(*(c.split()[0] for c in chunking.COLUMNS.split(", "))).collect() == made
    (tmp_path / "bad.json").write_text("no record\n")
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        files.read_json(spark, str(tmp_path / "bad.json"), "page").collect()


def test_object_stats(spark):
    kind = "width double, height double, raw_text string, text_blocks array<string>, image_rect_areas array<double>"
    rows = [(10.0, 10.0, "ab\ufffd", ["x", " \u00a0"], [30.0, -20.0]), (10.0, 10.0, None, None, [500.0]), (0.0, 10.0, "", [], None)]
    got = diagnose.object_stats(spark.createDataFrame(rows, kind)).collect()
    assert [(r.char_count, r.replacement_char_count, r.text_block_count, r.image_area_ratio) for r in got] == [(3, 1, 1, 0.5), (0, 0, 0, 1.0), (0, 0, 0, 0.0)]


def test_question_bench_takes_any_retriever(spark):
    chunks = spark.createDataFrame([("c1", "a", 5, 6), ("c2", "b", 9, 9)], "chunk_id string, text string, page_start int, page_end int")
    found = bench.question_bench(chunks, bench.fixed_questions(spark), 5000, retriever=lambda chunks, asked, k: asked.select("query_id", F.lit("c2").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")))
    assert [r.page_hit for r in found.orderBy("query_id").collect()] == [False, False, False, False, True]


def test_question_bench_without_hits(spark):
    chunks = spark.createDataFrame([("c1", "اوزون گاز است " * 5, 5, 6), ("c2", "آهن فلز است", 1, 1)], "chunk_id string, text string, page_start int, page_end int")
    rows_ = {r.query_id: r for r in bench.question_bench(chunks, bench.fixed_questions(spark), 5000).collect()}
    assert rows_[1].page_hit and rows_[1].retrieved_pages == [5, 6] and rows_[1].pipeline_rag.context_tokens < 100
    assert not rows_[4].page_hit and rows_[4].pipeline_rag.context_tokens == 0
    assert bench.summary(bench.question_bench(chunks, bench.fixed_questions(spark).limit(0), 5000)).first().asDict() == {"questions": 0, "retrieval_page_hit_rate": 0.0, "avg_input_token_reduction_pct": 0.0, "rag_context_tokens_avg": 0.0}


def test_cached_rows_from_json_get_defaults(spark):
    got = cache.from_json(spark.createDataFrame([('{"document_id":"d","page_no":2}',)], "value string")).first()
    assert (got.document_id, got.page_no, got.dpi, got.source_method, got.text) == ("d", 2, 200, "ocr", "")


def test_command_line(spark, tmp_path):
    span = {"type": 0, "bbox": [0, 10, 400, 20], "lines": [{"bbox": [0, 10, 400, 20], "spans": [{"text": LINE}]}]}
    page = {"document_id": "d", "checksum_sha256": "s", "width": 595.0, "height": 842.0, "raw_text": LINE + " " + LINE, "text_blocks": [LINE], "image_rect_areas": [], "image_count": 0, "drawing_count": 0, "font_count": 1, "blocks": [span]}
    (tmp_path / "p.jsonl").write_text("".join(json.dumps(page | {"page_number": n}) + "\n" for n in (1, 2, 3)))
    source = str(tmp_path / "p.jsonl")
    assert cli.main(["diagnose", str(tmp_path / "absent.pdf")]) == 2
    assert cli.main(["diagnose", source, "--pages", "1,3", "--outdir", str(tmp_path / "a")]) == 0
    assert json.loads(spark.read.text(str(tmp_path / "a/diagnosis.json")).first().value)["page_count"] == 2
    for _ in range(2):
        assert cli.main(["process", source, "--outdir", str(tmp_path / "b"), "--cache", str(tmp_path / "c")]) == 0
    assert json.loads((tmp_path / "b/bench.json").read_text())["pages_processed"] == 3
    assert cli.main(["process", source, "--outdir", str(tmp_path / "f"), "--include-blocks", "--strip-repeated", "--pages", "2"]) == 0
    (page,) = json.loads(spark.read.text(str(tmp_path / "f/document.json")).first().value)["pages"]
    assert page["page_number"] == 2 and [b["text"] for b in page["blocks"]] == [LINE] and page["text"] == LINE
    assert cli.main(["bench", source, "--outdir", str(tmp_path / "e")]) == 0
    assert json.loads((tmp_path / "e/token_benchmark.json").read_text())["questions"] == 5
