import pytest

from glossoloom.operators.records import ANNOTATION_COLUMNS
from glossoloom.plans import commands


def go(spark, *args):
    return commands.main(spark, [str(a) for a in args])


def test_from_blocks_to_alignment(spark, sf_dir, tmp_path):
    assert go(spark, "clean", "--blocks", f"{sf_dir}/ocr_blocks.parquet", "--out", tmp_path / "p") == 0
    assert go(spark, "segment", "--paragraphs", tmp_path / "p", "--abbreviation", "Dr.", "--out", tmp_path / "s") == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() > 10
    assert go(spark, "align", "--segments", f"{sf_dir}/segments.parquet", "--out", tmp_path / "a") == 0
    assert spark.read.parquet(str(tmp_path / "a")).filter("align_id IS NULL").count() == 0


def test_pool_and_candidates(spark, sf_dir, tmp_path, capsys):
    tables = {t: f"{sf_dir}/{t}.parquet" for t in ("occurrences", "segments", "alignments")}
    args = ["candidates", "--occurrences", tables["occurrences"], "--segments", tables["segments"], "--alignments", tables["alignments"], "--out", tmp_path / "c"]
    assert go(spark, *args) == 2 and "unresolved_segment" in capsys.readouterr().out
    assert not (tmp_path / "c").exists()
    assert go(spark, *args, "--allow-missing") == 0
    assert go(spark, "pool", "--occurrences", tables["occurrences"], "--keep-first", "--out", tmp_path / "pool") == 0
    assert go(spark, "qc", "--segments", tables["segments"], "--out", tmp_path / "q") == 0
    assert go(spark, "orphans", "--folder", sf_dir, "--out", tmp_path / "o") == 0
    assert go(spark, "context", "--segments", tables["segments"], "--alignments", tables["alignments"], "--out", tmp_path / "x") == 0
    assert go(spark, "id-impact", "--old", tables["segments"], "--new", tables["segments"], "--out", tmp_path / "i") == 0
    assert go(spark, "pilot", "--occurrences", tables["occurrences"], "--per-form", 10**6, "--out", tmp_path / "n") == 2


def test_existing_output_is_kept(spark, sf_dir, tmp_path):
    args = ["orphans", "--folder", sf_dir, "--out", tmp_path / "o"]
    assert go(spark, *args) == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        go(spark, *args)
    assert go(spark, *args, "--force-output") == 0


def test_extraction(spark, tmp_path):
    from test_operators import PHRASES

    (tmp_path / "in.conllu").write_text("\n\n".join(t for _, t in PHRASES) + "\n\n")
    assert go(spark, "extract", "--parsed", tmp_path / "in.conllu", "--form", "uncontracted", "--out", tmp_path / "t") == 0
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert "an dem Tor" in text
    assert go(spark, "normalize-mwt", "--parsed", tmp_path / "in.conllu", "--out", tmp_path / "n") == 0


def test_manifest_and_store(spark, tmp_path):
    from glossoloom.sources import files

    folder = tmp_path / "x"
    folder.mkdir()
    for form, rows in (("contracted", 2), ("uncontracted", 0)):
        (folder / f"bk_de_ch01_{form}.tsv").write_text("\t".join(files.EXTRACTION) + "\n" + ("\t".join(["x"] * 14) + "\n") * rows)
    args = ["manifest", "--folder", folder, "--book", "bk", "--out", tmp_path / "m"]
    assert go(spark, *args) == 2 and not (tmp_path / "m").exists()
    assert go(spark, *args, "--chapters", 1) == 0
    assert {(r.chapter, r.form, r.status, r.row_count) for r in spark.read.json(str(tmp_path / "m")).collect()} == {(1, "contracted", "ok", 2), (1, "uncontracted", "zero_hits_ok", 0)}
    rows = [("aa_de_ch01_p0001_s001", 1, "x"), ("aa_en_ch02_p0001_s001", 2, "y")]
    spark.createDataFrame(rows, "id string, chapter int, text string").write.parquet(str(tmp_path / "s"))
    assert go(spark, "store", "--segments", tmp_path / "s", "--out", tmp_path / "t") == 0
    assert (tmp_path / "t" / "lang=de" / "chapter=1").is_dir() and spark.read.parquet(str(tmp_path / "t")).filter("lang = 'en' AND chapter = 2").count() == 1
    spark.createDataFrame([("bad", 1, "x")], "id string, chapter int, text string").write.parquet(str(tmp_path / "b"))
    assert go(spark, "store", "--segments", tmp_path / "b", "--out", tmp_path / "u") == 2


def test_returned_csv(spark, tmp_path, capsys):
    row = {c: "" for c in ANNOTATION_COLUMNS} | {"id": "a", "chapter": "1", "row_hash": "h", "de_valid": "include"}
    df = spark.createDataFrame([tuple(row[c] for c in ANNOTATION_COLUMNS)], ", ".join(f"{c} string" for c in ANNOTATION_COLUMNS))
    df.write.parquet(str(tmp_path / "m"))
    assert go(spark, "annotation-csv", "--rows", tmp_path / "m", "--out", tmp_path / "r.csv") == 0
    assert go(spark, "validate-csv", "--csv", tmp_path / "r.csv", "--master", tmp_path / "m") == 0
    (tmp_path / "r.csv").write_bytes((tmp_path / "r.csv").read_bytes().replace(b"include", b"perhaps"))
    assert go(spark, "validate-csv", "--csv", tmp_path / "r.csv", "--master", tmp_path / "m") == 2 and "de_valid_invalid" in capsys.readouterr().out
