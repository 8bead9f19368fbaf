import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossoloom.functions import columns as C
from glossoloom.functions import lexicons as X
from glossoloom.functions import stuck
from glossoloom.operators import audit, checks, clean, context, segment, skew, trees
from glossoloom.sources import files, sinks
from glossoloom.streaming import incremental


#: A parsed German block with a multiword token, and an English one; all text is invented.
PHRASES = [
    ("de1", "# sent_id = aa_de_ch01_p0001_s001#b001\n# source_segment_id = aa_de_ch01_p0001_s001\n# text = Er ging im Haus an dem Tor.\n"
     "1\tEr\ter\tPRON\tPPER\t_\t2\tnsubj\t_\t_\n2\tging\tgehen\tVERB\tVVFIN\t_\t0\troot\t_\t_\n3-4\tim\t_\t_\t_\t_\t_\t_\t_\t_\n3\tim\tin\tADP\tAPPR\t_\t5\tcase\t_\t_\n4\tdem\tder\tDET\tART\t_\t5\tdet\t_\t_\n5\tHaus\tHaus\tNOUN\tNN\t_\t2\tobl\t_\t_\n6\tan\tan\tADP\tAPPR\t_\t8\tcase\t_\t_\n7\tdem\tder\tDET\tART\t_\t8\tdet\t_\t_\n8\tTor\tTor\tNOUN\tNN\t_\t2\tobl\t_\t_\n9\t.\t.\tPUNCT\t$.\t_\t2\tpunct\t_\t_"),
    ("en1", "# sent_id = aa_en_ch01_p0001_s001#b001\n# source_segment_id = aa_en_ch01_p0001_s001\n# text = He stood at the old gate.\n"
     "1\tHe\the\tPRON\tPRP\t_\t2\tnsubj\t_\t_\n2\tstood\tstand\tVERB\tVBD\t_\t0\troot\t_\t_\n3\tat\tat\tADP\tIN\t_\t6\tcase\t_\t_\n4\tthe\tthe\tDET\tDT\t_\t6\tdet\t_\t_\n5\told\told\tADJ\tJJ\t_\t6\tamod\t_\t_\n6\tgate\tgate\tNOUN\tNN\t_\t2\tobl\t_\t_\n7\t.\t.\tPUNCT\t.\t_\t2\tpunct\t_\t_"),
]


def phrase_blocks(spark):
    return trees.parse_blocks(spark.createDataFrame(PHRASES, "key string, text string"))


def test_phrases_of_written_parses(spark):
    """The token state machine, dependencies and ranges on blocks with full tags."""
    rows = phrase_blocks(spark)
    named = lambda forms, form: F.transform(trees.extract_phrases("tokens", forms, form == "contracted"), lambda p: p.withField("form", F.lit(form)))
    both = F.concat(named(tuple(X.CONTRACTIONS), "contracted"), named(X.PREPOSITIONS, "uncontracted"))
    hits = rows.select("key", "tokens", F.explode(both).alias("p")).select("key", "p.form", "p.prep", "p.det", "p.noun", trees.surface("tokens", "p.prep_token_id", "p.noun_token_id").alias("surface")).collect()
    assert {tuple(r) for r in hits} == {("de1", "contracted", "im", None, "Haus", "im dem Haus"), ("de1", "uncontracted", "an", "dem", "Tor", "an dem Tor")}
    told = rows.select("key", F.explode(trees.case_phrases("tokens")).alias("p")).select("key", "p.prep_surface", "p.head_lemma", "p.span_text", "p.span_token_ids").collect()
    assert {(*r[:4], tuple(r[4])) for r in told} == {("de1", "im", "Haus", "im dem Haus", (3, 4, 5)), ("de1", "an", "Tor", "an dem Tor", (6, 7, 8)), ("en1", "at", "gate", "at the old gate", (3, 4, 5, 6))}
    flat = {r.key: " ".join("/".join((t.id, t.form, t.head)) for t in r.t) for r in rows.select("key", trees.collapse_ranges("tokens").alias("t")).collect()}
    assert flat == {"de1": "1/Er/2 2/ging/0 3/im/4 4/Haus/2 5/an/7 6/dem/7 7/Tor/2 8/./2", "en1": "1/He/2 2/stood/0 3/at/6 4/the/6 5/old/6 6/gate/2 7/./2"}
    offsets = {r.key: r.o for r in rows.select("key", trees.token_offsets("sent_text", F.transform(trees.words_only("tokens"), lambda t: t["form"])).alias("o")).collect()}
    assert offsets["en1"] == [[0, 2], [3, 8], [9, 11], [12, 15], [16, 19], [20, 24], [24, 25]]


def test_numbers_before_and_hot_pairs(spark):
    rows = spark.createDataFrame([(f"s{i:03d}", i % 7) for i in range(200)], "scope string, n bigint").repartition(5)
    got = {r.scope: r.before for r in skew.sums_before(rows, ["scope"], "n", "before").collect()}
    assert got == {f"s{i:03d}": sum(k % 7 for k in range(i)) for i in range(200)} and skew.sums_before(rows.limit(0), ["scope"], "n", "before").count() == 0


def test_confidences(spark):
    values = [0.9, 0.1, None, 0.5, 0.5, 0.7, 0.95, 0.3, 0.9, 0.9, 1.0, 0.2]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), (None, 0.4)], "book string, confidence double")
    got = {r.book: (r.n, r.median, r.p10, r.low) for r in clean.confidence_summary(df, ["book"]).collect()}
    s = sorted(v for v in values if v is not None)
    assert got == {"a": (11, s[5], s[0], 5), "b": (0, None, None, 0), None: (1, 0.4, 0.4, 1)}


@pytest.mark.parametrize("text, want", [
    ("「到这儿来。」她说。他走了。", ["「到这儿来。」她说。", "他走了。"]),
    ("「好吧，」他说。完了。", ["「好吧，」他说。", "完了。"]),
    ("他来了。X", ["他来了。"]),
    ("他想“走。”吗？好！", ["他想“走。”", "吗？", "好！"]),
    ("", []),
])
def test_chinese_rule(text, want):
    assert segment.split_han_text(text) == want


def test_spaced_rule(spark):
    texts = ['Er kam. "Ja." Dr. X ging . . . dann.', "»Ende.« Neu!", None, "...", "A! B? C"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(segment.split_spaced("text", ("Dr.",))).collect()]
    assert got == [["Er kam.", '"Ja."', "Dr. X ging … dann."], ["»Ende.«", "Neu!"], None, [], ["A!", "B?", "C"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Apfel", "beim", "haus", "McX", "der", "Baum", "zzz"]), min_size=1, max_size=3))
def test_stuck_words_lose_nothing(parts):
    token = "".join(parts)
    assert "".join(stuck.split_token(token, frozenset({"apfel", "baum", "haus"}))) == token


def test_stuck_words():
    known = frozenset({"ersten", "Baum", "baum", "Apfelbaum"})
    assert stuck.split_text("„beimersten“ Apfelbaum, Endeder", known) == "„beim ersten“ Apfelbaum, Ende der"
    assert stuck.split_text("abc  x", known) == "abc  x"


BLOCK = "book string, lang string, chapter int, block_id string, page int, block_idx int, text string, bbox array<double>, confidence double, engine string, lines array<struct<spans:array<struct<text:string,size:double,flags:int>>>>"


def blocks(spark, rows):
    return spark.createDataFrame([("b", lang, 1, f"k{i}", p, i, t, box, c, e, None) for i, (lang, p, t, box, c, e) in enumerate(rows)], BLOCK)


def test_block_reasons_and_paragraphs(spark):
    box = [100.0, 0.0, 400.0, 10.0]
    rows = [("de", 1, "Kopf Zeile", box, 1.0, "pymupdf"), ("de", 1, "\x9117\x92", box, 1.0, "pymupdf"), ("de", 1, "* ·", box, 1.0, "pymupdf"), ("de", 1, "Er las das Kran-\nkenbuch und be-", box, 1.0, "pymupdf"), ("de", 2, "gann neu.", box, 1.0, "pymupdf"), ("de", 2, "Neu", [150.0, 0.0, 400.0, 1.0], 1.0, "pymupdf"), ("de", 2, "weg", [900.0, 0.0, 950.0, 1.0], 0.9, "paddleocr"), ("de", 2, "schwach", box, 0.1, "paddleocr"), ("de", 2, None, box, 1.0, "pymupdf"), ("de", 2, "Q", box, 1.0, "pymupdf")]
    df = blocks(spark, rows)
    got = {r.block_id: r.reason for r in clean.classify_blocks(df, ["KopfZeile"]).collect()}
    assert got == {"k0": "header", "k1": "page_number", "k2": "decorative", "k3": None, "k4": None, "k5": None, "k6": "outlier", "k7": "low_confidence", "k8": "empty", "k9": "single_letter"}
    paragraphs = clean.clean(df, headers=["KopfZeile"]).orderBy("paragraph").collect()
    assert [r.text for r in paragraphs] == ["Er las das Krankenbuch und begann neu.", "Neu"] and paragraphs[0].source_pages == [1, 2]
    assert clean.clean(df.limit(0)).count() == 0


def test_span_notes(spark):
    line = lambda *spans: {"spans": [{"text": t, "size": s, "flags": 0} for t, s in spans]}
    df = blocks(spark, [("zh", 1, "x", [0.0] * 4, 1.0, "pymupdf")]).withColumn("lines", F.from_json(F.lit(json.dumps([line(("正文", 12.0), ("1", 6.0)), line(("1", 6.0), ("注释", 9.0)), line(("小字", 9.0))])), "array<struct<spans:array<struct<text:string,size:double,flags:int>>>>"))
    r = clean.span_notes(df, 8.0, 10.0).collect()[0]
    assert r.text == "正文\n小字" and r.notes == ["注释"]


def test_windows_and_brackets(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["c"], ["b"], ["d"], [])], "ids array<string>, x array<string>, p array<string>, n array<string>, none array<string>")
    r = df.select(context.window_ids("ids", "x", F.lit(1)), context.window_ids("ids", "none", F.lit(1)), context.bracket_ids("ids", "p", "n", 6), context.bracket_ids("ids", "p", "n", 2), context.bracket_ids("ids", "n", "p", 6), context.bracket_ids("ids", "none", "none", 6)).collect()[0]
    assert list(r) == [["b", "c", "d"], None, ["b", "c", "d"], [], [], []]


def test_number_blocks_and_faults(spark):
    rows = [("f", 1, "s1#b001", "s1"), ("f", 2, "s1#b003", "s1"), ("f", 3, None, None), ("f", 4, "s2", "s2"), ("f", 5, "s3#b001", "s1"), ("f", 6, "s4#b001", None), ("f", 7, "s1#b001", "s1")]
    df = spark.createDataFrame(rows, "doc_id string, ord int, sent_id string, source_segment_id string")
    got = {r["ord"]: r.rule for r in trees.provenance_faults(df).collect()}
    assert got == {2: "ordinal_gap", 3: "orphan_block", 4: "unmigrated", 5: "prefix_mismatch", 6: "missing_source", 7: "duplicate"}


def test_conllu_round_trip(spark, tmp_path):

    rows = phrase_blocks(spark).withColumn("block_text", trees.block_text("sent_id", "source_segment_id", "sent_text", "tokens"))
    sinks.write_conllu(rows.coalesce(1), str(tmp_path / "x"))
    back = trees.parse_blocks(files.read_conllu(spark, str(tmp_path / "x")))
    assert {(r.sent_id, len(r.tokens)) for r in back.collect()} == {("aa_de_ch01_p0001_s001#b001", 10), ("aa_en_ch01_p0001_s001#b001", 7)}


def test_checks(spark):
    df = spark.createDataFrame([("x", "include", "other", "", "omitted", "", "", "sp", "", "", "", "")], "id string, de_valid string, de_exclusion_reason string, de_notes string, en_form string, en_notes string, en_alignment_confidence string, en_counterpart string, zh_form string, zh_notes string, zh_alignment_confidence string, zh_counterpart string")
    got = {r.rule for r in checks.coupling_faults(df).collect()}
    assert got == {"include_with_reason", "en_omitted_with_span", "en_form_without_confidence"}
    with pytest.raises(checks.RuleViolation) as e:
        checks.enforce(checks.coupling_faults(df))
    assert e.value.count == 1
    checks.enforce(checks.coupling_faults(df.limit(0)))


def test_binding(spark):
    master = spark.createDataFrame([("a", "h1", "x"), ("b", "h2", "y")], "id string, row_hash string, text string")
    back = spark.createDataFrame([("a", "h1", " x"), ("a", "h9", "z"), ("c", "h", "q"), ("", "", "")], "id string, row_hash string, text string")
    got = sorted((r.rule, r.key) for r in checks.binding_faults(back, master, ["text"]).collect())
    assert got == [("blank_id", ""), ("duplicate_id", "a"), ("edited_text", "a"), ("id_not_in_master", "c"), ("master_row_missing", "b"), ("row_hash_mismatch", "a")]


def test_annotation_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=1", 'a "b", c', "x\ny"), (None, "", "é")], "p string, q string, r string")
    path = str(tmp_path / "a.csv")
    sinks.write_annotation_csv(df, path)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfp,q,r\r\n") and b" =1," in raw
    back = files.read_returned_csv(spark, path)
    assert back.columns == ["p", "q", "r"] and {r.q for r in back.collect()} >= {'a "b", c'}
    with pytest.raises(FileExistsError):
        sinks.write_annotation_csv(df, path)


def test_jsonl_and_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], True, None)], "id string, ids array<string>, ok boolean, n int")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id string, ids array<string>, ok boolean, n int").collect() == df.collect()
    assert sinks.as_text(df).collect()[0].asDict() == {"id": "a", "ids": '["x", "y"]', "ok": "true", "n": ""}
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert files.read_table_text(spark, str(tmp_path / "t"), "id string, ids string, ok string, n string").collect()[0].ids == '["x", "y"]'


def test_sources(spark, tmp_path):
    with pytest.raises(files.SourceError) as e:
        files.check_source(files.RunConfig("b", "de", 1, 5, 2, str(tmp_path / "no")))
    assert len(e.value.problems) == 2
    (tmp_path / "one.txt").write_text("aa_de_ch01_p0001_s001 aa_de_ch01_p0001_s002")
    assert files.read_digests(spark, str(tmp_path), "*.txt").collect()[0].sha256 == files.file_digest(str(tmp_path / "one.txt"))
    old = spark.createDataFrame([("aa_de_ch01_p0001_s001", "x")], "id string, text string")
    got = {r.id[-1]: r.state for r in files.stale_references(spark, str(tmp_path), old, old).collect()}
    assert got == {"1": "stable", "2": "missing"}
    grid, have = spark.createDataFrame([(1,), (2,), (3,)], "chapter int"), spark.createDataFrame([(1, 5), (2, 0)], "chapter int, rows int")
    assert {(r.chapter, r.rule) for r in files.missing_inputs(grid, have, ["chapter"]).collect()} == {(2, "empty_input"), (3, "missing_input")}


def test_incremental_loading_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    store = str(tmp_path / "s")
    assert incremental.add_new(spark, df, store, ["k", "v"]) == 2 and incremental.add_new(spark, df, store, ["k", "v"]) == 0
    assert incremental.add_new(spark, df.limit(0), store, ["k", "v"]) == 0


def test_streaming(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.mode("append").parquet(src)
        q = incremental.load_stream(spark.readStream.schema("k int, v string").parquet(src), store, str(tmp_path / "cp"), ["k", "v"])
        q.awaitTermination()
    assert spark.read.parquet(store).count() == 2


def test_differences(spark):
    df = spark.createDataFrame([("c", "a" * 40 + "x" * 30, "a" * 40), ("d", None, "")], "key string, old string, new string")
    assert [(r.key, r.op, len(r.old_text)) for r in audit.chapter_differences(df).collect()] == [("c", "delete", 30)]


def test_stuck_words_with_every_word_that_occurs_twice(spark, tmp_path):
    from glossoloom.plans import cleaning

    # 120 000 words: a share of them would drop the rare names
    fill = [("f", "und " * 60_000), ("g", "und " * 60_000)]
    rows = [*fill, ("a", "sie sah plaunstein und trellweg,"), ("b", "in plaunstein am trellweg"), ("c", "bei plaunsteintrellweg! Ende"), ("d", None), ("e", "")]
    spark.createDataFrame([("de", *r) for r in rows], "lang string, paragraph_id string, text string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    assert [tuple(r) for r in cleaning.stuck_words(spark, str(tmp_path)).collect()] == [("c", "bei plaunstein trellweg! Ende")]


def test_stuck_words_by_join_are_those_of_the_whole_list(spark):
    texts = ["„beimersten“ Apfelbaum, Endeder", "Einhaus imgarten", "der Apfelbaum steht imHaus", "", None]
    known = ["apfel", "baum", "haus", "ersten", "Ende", "garten"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.split for r in clean.split_stuck_words(df, spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    assert got == {t: None if t is None else stuck.split_text(t, frozenset(known)) for t in texts}


def test_running_titles_of_any_book(spark, tmp_path):
    from glossoloom.plans import cleaning

    head = {1: "Der kalte Ofen", 2: "DER KALTE OFEN  2", 3: "D E R  K A L T E  O F E N", 4: "4  Der kalte Ofen"}
    rows = [("aa", "de", 1, f"b{p}", p, 0, t) for p, t in head.items()] + [("aa", "de", 1, f"c{p}", p, 1, t) for p, t in enumerate(["Er ging.", "Er kam.", "Er ging.", "Ein Satz ohne Titel"], 1)]
    rows += [("bb", "de", 1, "d1", 1, 0, "Der kalte Ofen"), ("aa", "de", 1, "e1", 5, 0, "Der kalte Ofen\nwar aus."), ("aa", "zh", 1, "f1", 1, 0, "冷炉子"), ("aa", "zh", 1, "f2", 2, 0, "冷炉子"), ("aa", "de", 1, "g1", 5, 1, None)]
    df = spark.createDataFrame(rows, "book string, lang string, chapter int, block_id string, page int, block_idx int, text string")
    df.selectExpr("*", "cast(NULL AS array<double>) AS bbox", "1D AS confidence", "'pymupdf' AS engine", "timestamp'2023-01-01' AS loaded_at").write.parquet(f"{tmp_path}/ocr_blocks.parquet")
    got = {(r.book, r.lang, r.reason): r.n for r in cleaning.block_reasons(spark, str(tmp_path)).collect()}
    assert got == {("aa", "de", "header"): 4, ("aa", "de", "kept"): 5, ("aa", "de", "empty"): 1, ("bb", "de", "kept"): 1, ("aa", "zh", "header"): 2}
    whole = " ".join(r.text for r in cleaning.paragraph_assembly(spark, str(tmp_path)).filter("book = 'aa'").collect())
    assert "KALTE" not in whole and "Der kalte Ofen war aus." in whole


def test_regions(spark):
    body, lost, gone = "abcdefghijklmnopqrstuvwxyz" * 20, "0123456789" * 3, "ÄÖÜäöüß€§$" * 3
    df = spark.createDataFrame([("c", body, lost + body, body[:260] + lost + body[260:] + gone), ("d", None, None, "short"), ("e", body, body, body)], "key string, old string, raw string, new string")
    got = sorted((r.key, r.op, r.at, r.new_text, r.verdict) for r in audit.chapter_regions(df).collect())
    assert got == [("c", "insert", 260, lost, "absent"), ("c", "insert", 550, gone, "absent")]
    moved = spark.createDataFrame([("c", body, body + lost * 10, body[:260] + lost * 10 + body[260:])], "key string, old string, raw string, new string")
    assert [(r.op, r.verdict) for r in audit.chapter_regions(moved).collect()] == [("insert", "dropped_in_cleaning")]


def test_regions_of_a_long_chapter_in_time(spark):
    import random
    import time

    draw = random.Random(7)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    body, lost, gone = word(90_000), word(60).upper(), word(40).upper()
    new = body[:20_000] + lost + body[20_000:50_000] + gone + body[50_000:]
    df = spark.createDataFrame([("c", body, body + "." * 240 + lost + "." * 240, new)], "key string, old string, raw string, new string")
    began = time.monotonic()
    got = {(r.op, r.at, r.new_text): (r.ratio_old, r.ratio_raw) for r in audit.chapter_regions(df).collect()}
    assert time.monotonic() - began < 20  # in quadratic time 60 000 characters took 22 s
    assert list(got) == [("insert", 20_000, lost), ("insert", 50_060, gone)]
    assert got["insert", 20_000, lost][1] == 2 * 60 / 360


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "der alte Ofen", "ein Satz, der wiederkehrt; ", "xyzxyzxyzxyzxyzxyzxyz", "冷炉子", "😀"]), max_size=30), st.lists(st.integers(0, 40), max_size=6), st.integers(1, 40))
def test_matching_is_that_of_difflib(parts, moves, n):
    from difflib import SequenceMatcher

    from glossoloom.functions import matching

    a = "".join(parts)
    for k in moves:
        parts = parts[k : k + 5] + parts[:k] + parts[k + 3 :]
    b = "".join(parts)
    same = lambda x, y: SequenceMatcher(None, x, y, autojunk=False)
    assert list(matching.differences(a, b)) == [x for x in same(a, b).get_opcodes() if x[0] != "equal"]
    assert a == b or list(matching.differences(a, "")) == [x for x in same(a, "").get_opcodes() if x[0] != "equal"]
    for needle in {b[n : n + 25], b[:n], b}:
        best = 0.0
        for i in range(0, max(1, len(a) - n + 1), max(1, n // 3)) if needle else ():
            best = max(best, same(a[i : i + n], needle[:n]).ratio())
            if best > 0.95:
                break
        assert audit.best_local_ratio(a, needle, n) == best


def test_source_counts(spark, sf_dir):
    from glossoloom.plans import corpus
    from glossoloom.session import read_table

    rows = corpus.source_counts(spark, sf_dir).collect()
    assert sum(r.segments for r in rows) == read_table(spark, sf_dir, "segments").select("id").distinct().filter("id IS NOT NULL").count()
    spans = "array(struct(array(struct('1' AS text, 6D AS size, 0 AS flags), struct('a note' AS text, 8D AS size, 0 AS flags)) AS spans), struct(array(struct('body' AS text, 12D AS size, 0 AS flags)) AS spans))"
    df = spark.sql(f"SELECT {spans} AS lines UNION ALL SELECT NULL")
    assert sorted(r[0] for r in df.select(clean.marker_count(9.0)).collect()) == [0, 1]


def test_small_functions(spark):
    r = spark.sql("SELECT array(array(3D, 1D), array(2D, 5D)) AS p, array(30, 60, 600) AS l, '=x' AS e").select(C.bbox_of("p"), C.extra_penalty("l"), C.excel_safe("e"), C.length_prior(F.lit(345), F.lit(100), 3.45, 1.1, 0.05), C.length_prior(F.lit(0), F.lit(1), 1.0, 0.0, 1.0)).collect()[0]
    assert list(r) == [[2.0, 1.0, 3.0, 5.0], 2.0, " =x", 0.0, 0.0]


def test_scratch_is_deleted(spark):
    from glossoloom import session

    kept = dict(session._written)
    session._written.clear()
    path = session.materialize(spark.range(3), "x").inputFiles()[0]
    assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    from pathlib import Path

    assert not Path(path.removeprefix("file:")).exists() and not Path(path.removeprefix("file:")).parent.exists()
    session._written.update(kept)
