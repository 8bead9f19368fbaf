import pytest
from pyspark.sql import functions as F

from glossoloom.operators import align, inputs
from glossoloom.sources import files, sinks


def test_sides(spark):
    i = lambda lang, n: f"aa_{lang}_ch01_p0001_s{n:03d}"
    rows = [
        ("plain", [i("de", 1)], [i("en", 1)], ("de", "en", None)),
        ("empty", [i("de", 1)], [], ("de", "en", None)),
        ("null", None, [i("en", 1)], ("de", "en", None)),
        ("both", [], [], (None, None, None)),
        ("mixed", [i("de", 1), i("en", 2)], [i("en", 1)], (None, None, "mixed")),
        ("odd", [i("de", 1)], [i("zh", 1)], (None, None, "unexpected")),
        ("bad", [i("de", 1)], ["x", None], (None, None, "unparseable")),
        ("twice", [i("de", 1)], [i("de", 1), i("de", 2)], (None, None, "repeated")),
        ("same", [i("de", 1)], [i("de", 1)], ("de", None, None)),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "align_id string, src array<string>, tgt array<string>")
    got = inputs.side_languages(df, F.array(F.lit("de"), F.lit("en"))).collect()
    assert {r.align_id: (r.src_side, r.tgt_side, r.fault) for r in got} == {r[0]: r[3] for r in rows}
    assert inputs.side_languages(df.limit(0), F.array(F.lit("de"))).count() == 0


def test_flags_keep_rows_of_hot_keys(spark):
    rows = spark.createDataFrame([("in", "Haus")] * 900 + [("in", None), ("zu", "Tor"), ("an", "Tor")], "prep string, noun string")
    listed = spark.createDataFrame([("in", "Haus"), ("in", "Haus"), ("an", "Tor"), (None, None)], "prep string, noun string")
    got = inputs.flagged(rows, listed, ["prep", "noun"], "hit").groupBy("prep", "noun", "hit").count().collect()
    assert {tuple(r) for r in got} == {("in", "Haus", "Y", 900), ("in", None, "N", 1), ("zu", "Tor", "N", 1), ("an", "Tor", "Y", 1)}


def test_cache(spark, tmp_path):
    rows = [("de", "s1", 0, "a", "Haus"), ("de", "s1", 1, "b", None), ("de", "s2", 0, "c", "Turm")]
    schema = "lang string, scope string, pos int, id string, text string"
    df, store = spark.createDataFrame(rows, schema), f"{tmp_path}/vectors"
    first = {r.id: r.vector for r in inputs.embed_cached(df, align.HashEncoder(), store).collect()}
    assert set(first) == {"a", "b", "c"} and spark.read.parquet(store).count() == 3
    again = spark.createDataFrame([*rows, ("de", "s3", 0, "d", "Brief")], schema)
    assert {r.id: r.vector for r in inputs.embed_cached(again, align.HashEncoder(), store).collect()} == first | {"d": list(align.HashEncoder().encode(["Brief"])[0])}
    changed = spark.createDataFrame([(*r[:4], "Tor") if r[3] == "a" else r for r in rows], schema)
    assert inputs.embed_cached(changed, align.HashEncoder(), store).count() == 3 and spark.read.parquet(store).count() == 6
    with pytest.raises(ValueError):
        inputs.embed_cached(df.union(df), align.HashEncoder(), store)
    old = df.select("scope", "id", "text")
    new = spark.createDataFrame([("s1", "a", "Haus"), ("s1", "b", ""), ("s2", "c", "Tor"), ("s3", "e", "x")], "scope string, id string, text string")
    assert {r.scope: r.outcome for r in inputs.cache_outcomes(new, old, ["scope"]).collect()} == {"s1": "hit", "s2": "texts_differ", "s3": "missing"}


def test_names_and_numbers(spark):
    got = spark.sql("SELECT ' a/b c' AS x, '' AS y, '12' AS n, 'q' AS m").select(inputs.slug("x"), inputs.slug("y"), inputs.int_or_minus("n"), inputs.int_or_minus("m"), inputs.int_or_minus("y")).collect()[0]
    assert tuple(got) == ("a_b_c", "model", 12, -1, -1)


def test_extractions_are_whole_or_nothing(spark, tmp_path):
    head = "\t".join(files.EXTRACTION) + "\n"
    for c in (1, 2):
        for f in ("contracted", "uncontracted"):
            (tmp_path / f"book_de_ch{c:02d}_{f}.tsv").write_text(head + ("" if c == 2 else "\t".join(["x"] * 14) + "\n"))
    got = files.read_extractions(spark, str(tmp_path), range(1, 3))
    assert {(r.chapter, r.form, r.prep) for r in got.collect()} == {(1, "contracted", "x"), (1, "uncontracted", "x")}
    (tmp_path / "book_de_ch02_contracted.tsv").write_text("parse_block_id\n")
    (tmp_path / "book_de_ch01_uncontracted.tsv").unlink()
    with pytest.raises(files.SourceError) as e:
        files.read_extractions(spark, str(tmp_path), range(1, 3))
    assert len(e.value.problems) == 2 and "no file book_de_ch01_uncontracted.tsv" in e.value.problems


def test_master_manifest_and_parsed_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", 4)], "datapoint_id string, n int")
    assert {r.datapoint_id for r in files.unique_rows(df).collect()} == {"a", "b"}
    with pytest.raises(files.SourceError):
        files.unique_rows(df.union(df))
    (tmp_path / "m.json").write_text('[{"chapter": 1, "form": "contracted", "status": "ok", "row_count": 3}, {"chapter": 2, "form": "contracted", "status": "extraction_error", "error": "x"}]')
    jobs = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert {tuple(r) for r in sinks.manifest_rows(jobs).select("chapter", "status", "error").collect()} == {(1, "ok", None), (2, "extraction_error", "x")}
    block = "# sent_id = {}\n1\tx\tx\tX\t_\t_\t0\troot\t_\t_\n\n"
    (tmp_path / "a.conllu").write_text(block.format("s1") + block.format("s2"))
    (tmp_path / "b.conllu").write_text(block.format("s3"))
    assert {r.sent_id for r in files.read_parsed(spark, str(tmp_path)).collect()} == {"s1", "s2", "s3"}
    (tmp_path / "b.conllu").write_text(block.format("s1"))
    with pytest.raises(files.SourceError):
        files.read_parsed(spark, str(tmp_path))


def test_fingerprint_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub" / "w.bin").write_bytes(b"1")
    (tmp_path / "c.json").write_bytes(b"2")
    one = files.folder_fingerprint(spark, str(tmp_path))
    (tmp_path / ".git" / "x").write_bytes(b"3")
    assert files.folder_fingerprint(spark, str(tmp_path)) == one
    files.check_fingerprint(one, {"m": one}, "m")
    (tmp_path / "c.json").write_bytes(b"4")
    with pytest.raises(files.SourceError):
        files.check_fingerprint(files.folder_fingerprint(spark, str(tmp_path)), {"m": one}, "m")
