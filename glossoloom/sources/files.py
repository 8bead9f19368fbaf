"""Readers: JSON lines, tables, CoNLL-U blocks, files as bytes, run configurations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


class SourceError(ValueError):
    """A source that is missing or not what it should be; ``problems`` names each fault."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_table_text(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A table with a header, all columns as in ``schema``; adds chapter and form when the file name has them."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)
    name = F.col("_metadata.file_name")
    return rows.select("*", F.expr("try_cast(regexp_extract(_metadata.file_name, 'ch([0-9]+)', 1) AS int)").alias("file_chapter"), F.nullif(F.regexp_extract(name, "(uncontracted|contracted)", 1), F.lit("")).alias("file_form"))


#: The columns an extraction table must have.
EXTRACTION = ("parse_block_id", "source_segment_id", "prep", "det", "noun", "prep_token_id", "det_token_id", "noun_token_id", "pp_token_start", "pp_token_end", "pp_surface", "det_xpos", "det_deprel", "in_filter")


def read_extractions(spark: SparkSession, folder: str, chapters: range = range(1, 18), book: str = "book", lang: str = "de") -> DataFrame:
    """The extraction tables of all chapters, contracted and uncontracted, with ``chapter`` and ``form`` from their names.

    The set counts as a whole: a file that is missing, or one without a required column, is an error that names all
    such files. Tables with a header only have no rows.
    """
    wanted = {(c, f): f"{book}_{lang}_ch{c:02d}_{f}.tsv" for c in chapters for f in ("contracted", "uncontracted")}
    here = {p.name for p in Path(folder).glob("*.tsv")}
    problems = [f"no file {name}" for name in wanted.values() if name not in here]
    for name in sorted(here & set(wanted.values())):
        with open(Path(folder) / name, encoding="utf-8") as f:
            lacking = set(EXTRACTION) - set(f.readline().rstrip("\r\n").split("\t"))
        if lacking:
            problems.append(f"{name} lacks {', '.join(sorted(lacking))}")
    if problems:
        raise SourceError(problems)
    rows = spark.read.option("header", True).option("sep", "\t").schema(", ".join(f"`{c}` string" for c in EXTRACTION)).option("enforceSchema", False).csv([f"{folder}/{name}" for name in wanted.values()])
    name = F.col("_metadata.file_name")
    return rows.select("*", F.regexp_extract(name, r"_ch([0-9]+)_", 1).cast("int").alias("chapter"), F.regexp_extract(name, r"_(uncontracted|contracted)\.tsv$", 1).alias("form"))


def unique_rows(rows: DataFrame, key: str = "datapoint_id") -> DataFrame:
    """The rows that have a key, if none has it twice; otherwise an error that names the first repeated ones."""
    kept = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    repeated = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(key).limit(3).collect()
    if repeated:
        raise SourceError([f"{key} {r[0]} stands {r.n} times" for r in repeated])
    return kept


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, form, status, row_count, error) of a manifest, which is one JSON array."""
    return spark.read.option("multiLine", True).schema("chapter int, form string, status string, row_count bigint, error string").json(path)


def read_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all parsed files of a folder: (file, text, sent_id); a sent_id that two files hold is an error."""
    blocks = read_conllu(spark, f"{folder}/*.conllu").withColumn("sent_id", F.nullif(F.regexp_extract("text", r"(?m)^#\s*sent_id\s*=\s*(.*?)\s*$", 1), F.lit("")))
    shared = blocks.filter("sent_id IS NOT NULL").groupBy("sent_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").orderBy("sent_id").limit(3).collect()
    if shared:
        raise SourceError([f"{r.sent_id} stands in {r.n} files" for r in shared])
    return blocks


def folder_fingerprint(spark: SparkSession, folder: str, inert: tuple[str, ...] = (".git", ".cache", ".locks")) -> str:
    """One digest of all files of a folder by relative name and content; what lies under an inert entry does not count."""
    root = Path(folder).resolve()
    rows = read_digests(spark, str(root)).select(F.regexp_replace("path", r"^[a-z]+:/+", "/").alias("path"), "sha256").collect()
    named = sorted((str(Path(r.path).relative_to(root)), r.sha256) for r in rows)
    kept = [f"{name}\x1f{digest}" for name, digest in named if not set(Path(name).parts) & set(inert)]
    return hashlib.sha256("\n".join(kept).encode()).hexdigest()


def check_fingerprint(found: str, pinned: dict[str, str], name: str) -> None:
    """Raise unless ``name`` is pinned to the digest that was found."""
    if pinned.get(name) != found:
        raise SourceError([f"{name} is pinned to {pinned.get(name)}, found {found}"])


def read_returned_csv(spark: SparkSession, path: str) -> DataFrame:
    """A returned CSV as text columns: byte order mark, CRLF and line breaks in quotes are fine."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return rows.withColumnsRenamed({c: c.lstrip("\ufeff").strip('"') for c in rows.columns if c != c.lstrip("\ufeff").strip('"')})


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): blocks parted by blank lines, one row each."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")).filter(F.trim("text") != "")


def read_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def page_images(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Images whose name ends in a page number of the range; an error if there is none."""
    page = F.expr("try_cast(regexp_extract(path, '([0-9]+)\\\\.[A-Za-z]+$', 1) AS int)")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path).withColumn("page", page).filter(F.col("page").between(first, last))
    if not found.select("page").head(1):
        raise SourceError([f"no page image from {first} to {last}"])
    return found


def text_layer(blocks: DataFrame, by: list[str], sample: int = 5, least: int = 50) -> DataFrame:
    """(*by, has_layer): is the median text length of ``sample`` evenly spread pages above ``least``?"""
    pages = blocks.groupBy(*by, "page").agg(F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"))
    lists = pages.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "chars"))), lambda x: x["chars"]).alias("c"))
    n = F.size("c")
    picked = F.transform(F.sequence(F.lit(0), F.least(F.lit(sample), n) - 1), lambda i: F.get(F.col("c"), F.floor(i * n / F.least(F.lit(sample), n)).cast("int")))
    s = F.array_sort(picked)
    middle = (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return lists.select(*by, (middle > least).alias("has_layer"))


@dataclass(frozen=True)
class RunConfig:
    """A run over one chapter of one book."""

    book: str
    lang: str
    chapter: int
    first_page: int
    last_page: int
    source: str = ""
    sha256: str | None = None
    headers: tuple[str, ...] = ()
    opening_quotes: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ()
    min_confidence: float = 0.4
    note_sizes: tuple[float, float] | None = None
    engine: str = "pymupdf"
    other: dict = field(default_factory=dict, compare=False)


def load_config(path: str) -> RunConfig:
    """A run configuration from YAML; needs the optional yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise SourceError(["reading YAML needs the optional package yaml"]) from e
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    c, clean = raw["chapter"], raw.get("clean", {})
    notes = clean.get("footnote_spans")
    return RunConfig(
        raw["book"], raw["lang"], int(c["number"]), int(c["start_page"]), int(c["end_page"]), raw.get("pdf_path", ""), raw.get("expected_sha256"), tuple(clean.get("header_patterns", ())),
        tuple(clean.get("paragraph_detection", {}).get("dialogue_markers", ())), tuple(raw.get("segment", {}).get("abbreviations", ())), float(clean.get("min_confidence", 0.4)),
        (float(notes["marker_max_size"]), float(notes["note_max_size"])) if notes else None, raw.get("ocr", {}).get("engine", "pymupdf"), raw,
    )


def file_digest(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def check_source(config: RunConfig) -> None:
    """Raise for a source file that is missing or has another digest."""
    p = Path(config.source)
    problems = [] if p.is_file() else [f"no file {p}"]
    if p.is_file() and config.sha256 and file_digest(str(p)) != config.sha256:
        problems.append("another sha256 than expected")
    if config.first_page > config.last_page:
        problems.append("page range is reversed")
    if problems:
        raise SourceError(problems)


def missing_inputs(expected: DataFrame, found: DataFrame, keys: list[str], may_be_empty: DataFrame | None = None) -> DataFrame:
    """Expected files that are missing or empty: (*keys, rule). ``found`` has a row count per file; listed pairs may be empty."""
    joined = expected.join(found.select(*keys, "rows"), keys, "left")
    if may_be_empty is not None:
        joined = joined.join(may_be_empty.select(*keys).withColumn("_fine", F.lit(True)), keys, "left")
    else:
        joined = joined.withColumn("_fine", F.lit(None).cast("boolean"))
    rule = F.when(F.col("rows").isNull(), "missing_input").when((F.col("rows") == 0) & ~F.coalesce("_fine", F.lit(False)), "empty_input")
    return joined.withColumn("rule", rule).filter("rule IS NOT NULL").select(*keys, "rule")


def stale_references(spark: SparkSession, path: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """Segment ids named in the files under a folder, as stable, shifted or missing: (file, id, state)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    named = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"[a-z0-9]+_[a-z]+_ch\d{2}_p\d{4}_s\d{3}"), F.lit(0)))).alias("id"))
    joined = named.join(old.select("id", F.col("text").alias("_a")), "id", "left").join(new.select("id", F.col("text").alias("_b")), "id", "left")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a") == F.col("_b"), "stable").otherwise("shifted")
    return joined.select("file", "id", state.alias("state"))


__all__ = [n for n in dir() if n.startswith(("read_", "load_", "check_", "missing_", "stale_", "unique_", "folder_")) or n in ("EXTRACTION", "page_images", "text_layer", "RunConfig", "SourceError", "file_digest", "S")]
