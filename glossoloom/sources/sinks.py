"""Writers: JSON lines, tables as text, CoNLL-U, annotation CSV and the partitioned store."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_store(df: DataFrame, path: str, keys: tuple[str, ...] = ("lang", "chapter"), overwrite: bool = False) -> None:
    """Parquet partitioned by language and chapter; rows of a partition are gathered first, so files stay few."""
    df.repartition(*keys).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: lists as JSON, booleans as true/false, null as nothing."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        v = F.when(F.size(c) == 0, "[]").otherwise(C.python_json_list(c)) if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        out.append(F.coalesce(v, F.lit("")).alias(f.name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, placeholder: str | None = None, overwrite: bool = False) -> None:
    """A table with header and tabs; with a placeholder for null, else empty. An empty frame writes its header."""
    rows = df.na.fill(placeholder) if placeholder is not None else as_text(df)
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def conllu_text(df: DataFrame, text: str = "block_text") -> DataFrame:
    return df.select(F.concat(F.col(text), F.lit("\n")).alias("value"))


def write_conllu(df: DataFrame, path: str, text: str = "block_text", overwrite: bool = False) -> None:
    """Blocks of text parted by blank lines."""
    conllu_text(df, text).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").text(path)


def annotation_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines, quoted only where needed, cells made safe for spreadsheets."""
    def cell(c: str):
        v = C.excel_safe(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(v.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def write_annotation_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One file for a human reader, with byte order mark and CRLF, streamed to disk partition by partition."""
    if Path(path).exists() and not overwrite:
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\ufeff" + ",".join(df.columns) + "\r\n")
        for r in annotation_lines(df).toLocalIterator():
            f.write(r.line + "\r\n")


def manifest_rows(jobs: DataFrame) -> DataFrame:
    """Manifest entries; an error text is kept for error states only."""
    bad = F.col("status").isin("missing_input", "empty_input", "extraction_error")
    return jobs.withColumn("error", F.when(bad, F.col("error")))
