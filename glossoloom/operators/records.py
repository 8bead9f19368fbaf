"""Rows that fail to parse: a quote-aware finite-state reader of delimited records.

The reader is a five-state automaton over symbol classes. A text is cut into chunks; each chunk yields the map from
every possible entry state to its exit state, and the composition of these maps gives the true entry state of each
chunk, so chunks of one file or of one very long record can be read independently and in any order. Records come
out as fields, or as the reason and the character offset at which they stop being valid RFC 4180.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: States: start of a field, in a bare field, in a quoted field, after a quote in a quoted field, broken.
FIELD, BARE, QUOTED, CLOSED, BROKEN = range(5)
#: Symbol classes: other text, quote, comma, line end.
TEXT, QUOTE, COMMA, LINE = range(4)
STEP = (
    # TEXT    QUOTE   COMMA   LINE
    (BARE, QUOTED, FIELD, FIELD),  # FIELD
    (BARE, BROKEN, FIELD, FIELD),  # BARE
    (QUOTED, CLOSED, QUOTED, QUOTED),  # QUOTED
    (BROKEN, QUOTED, FIELD, FIELD),  # CLOSED
    (BROKEN, BROKEN, BROKEN, BROKEN),  # BROKEN
)
CLASS = {'"': QUOTE, ",": COMMA, "\r": LINE, "\n": LINE}
IDENTITY = tuple(range(5))
_RUN = re.compile(r'[^",\r\n]+|.', re.S)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
        T.StructField("offset", T.IntegerType()),
    ]
)


def transition(chunk: str) -> tuple[int, ...]:
    """Exit state for each entry state. A run of ordinary characters acts like a single one."""
    states = IDENTITY
    for m in _RUN.finditer(chunk):
        c = CLASS.get(m.group()[0], TEXT)
        states = tuple(STEP[s][c] for s in states)
        if states == (BROKEN,) * 5:
            break
    return states


def compose(first: tuple[int, ...], second: tuple[int, ...]) -> tuple[int, ...]:
    """The map of two adjacent chunks; associative, with IDENTITY as unit."""
    return tuple(second[s] for s in first)


def entry_states(maps: list[tuple[int, ...]]) -> list[int]:
    """True entry state of each chunk, the first being entered at the start of a field."""
    out, so_far = [], IDENTITY
    for m in maps:
        out.append(so_far[FIELD])
        so_far = compose(so_far, m)
    return out


def read_chunk(chunk: str, state: int, base: int, fields: list[str], held: list[str]) -> tuple[int, str | None, int]:
    """Read a chunk entered in ``state``; completed fields go to ``fields``, the open one stays in ``held``.

    Returns the exit state, and the reason and offset of the first fault, or None and -1.
    """
    for m in _RUN.finditer(chunk):
        s, c = m.group(), CLASS.get(m.group()[0], TEXT)
        if c == LINE and state != QUOTED:
            return state, "line_break_outside_quotes", base + m.start()
        after = STEP[state][c]
        if after == BROKEN:
            return state, "quote_in_bare_field" if state == BARE else "text_after_closing_quote", base + m.start()
        if c == COMMA and state != QUOTED:
            fields.append("".join(held))
            held.clear()
        elif not (c == QUOTE and after in (QUOTED, CLOSED) and state != CLOSED):
            held.append(s)  # ordinary text, separators inside quotes, and the second of a doubled quote
        state = after
    return state, None, -1


def read_record(line: str | None, width: int | None = None, chunk: int = 1 << 16) -> tuple[list[str] | None, str | None, int | None]:
    """One raw record to (fields, None, None) or (None, reason, offset). One CR at the end is allowed.

    Null is ``null_record`` at 0. With ``width`` an empty record is one empty field like any other.
    """
    if line is None:
        return None, "null_record", 0
    text = line[:-1] if line.endswith("\r") else line
    pieces = [text[i : i + chunk] for i in range(0, len(text), chunk)] or [""]
    states = entry_states([transition(p) for p in pieces]) if len(pieces) > 1 else [FIELD]
    fields: list[str] = []
    held: list[str] = []
    state = FIELD
    for i, (p, entry) in enumerate(zip(pieces, states)):
        state, reason, at = read_chunk(p, entry, i * chunk, fields, held)
        if reason:
            return None, reason, at
    if state == QUOTED:
        return None, "unclosed_quote", len(text)
    fields.append("".join(held))
    if width is not None and len(fields) != width:
        return None, "too_few_fields" if len(fields) < width else "too_many_fields", len(text)
    return fields, None, None


def split_records(df: DataFrame, line: str = "line", width: int | None = None, out: str = "record") -> DataFrame:
    """Add ``out`` struct<fields array<string>, reason string, offset int> read from the raw record in ``line``.

    Every row of ``df`` comes out once with all its columns; an existing column ``out`` is replaced. Empty text is a
    record of one empty field; null has the reason ``null_record``.
    """

    @F.pandas_udf(RECORD_SCHEMA)
    def parse(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_record(x, width) for x in lines], columns=["fields", "reason", "offset"]).astype({"offset": "Int32"})

    return df.withColumn(out, parse(F.col(line)))


def chunk_entry_states(chunks: DataFrame, file: str = "file", no: str = "chunk_no", text: str = "text", block: int = 1024) -> DataFrame:
    """Entry state of each chunk of each file, by composition of transition maps in as many levels as needed.

    ``block`` neighbours make a block, whose maps compose to one; blocks make blocks in turn until each file has one.
    States then spread downward. A task holds the maps of one block, five digits each, whatever the size of a file,
    and walks them once. Null text acts as empty. Adds ``entry_state int``.
    """

    @F.pandas_udf("string")
    def maps(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(map(str, transition(x or ""))))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Composition of the maps before each row of a block, and of all of them."""
        pdf = pdf.sort_values("no", ignore_index=True)
        acc, before = "01234", []
        for m in pdf["map"]:
            before.append(acc)
            acc = "".join(m[int(x)] for x in acc)
        return pdf.assign(before=before, whole=acc).drop(columns="map")

    def entries(level: DataFrame, last: int) -> DataFrame:
        """(file, no, before): the composition of all maps of a file before each of its rows."""
        walked = level.withColumn("block", F.floor(F.col("no") / block)).groupBy("file", "block").applyInPandas(walk, f"{shape}, block bigint, before string, whole string")
        if last < block:
            return walked.select("file", "no", "before")
        walked = materialize(walked, "chunk-maps")
        above = entries(walked.select("file", F.col("block").alias("no"), F.col("whole").alias("map")).distinct(), last // block)
        above = above.select(F.col("file").alias("_f"), F.col("no").alias("_b"), F.col("before").alias("_above"))
        met = walked.join(above, walked["file"].eqNullSafe(above["_f"]) & (F.col("block") == F.col("_b")))
        compose = F.concat(*[F.expr(f"substring(before, int(substring(_above, {i}, 1)) + 1, 1)") for i in range(1, 6)])
        return met.select("file", "no", compose.alias("before"))

    told = chunks.select(F.col(file).alias("file"), F.col(no).cast("bigint").alias("no"), maps(F.col(text)).alias("map"))
    shape = f"file {told.schema['file'].dataType.simpleString()}, no bigint"
    last = told.agg(F.max("no")).first()[0] or 0
    found = entries(told, last).select(F.col("file").alias("_f"), F.col("no").alias("_n"), F.substring("before", 1, 1).cast("int").alias("entry_state"))
    return chunks.join(found, F.col(file).eqNullSafe(F.col("_f")) & (F.col(no) == F.col("_n")), "left").drop("_f", "_n")


def classify(df: DataFrame, columns: list[str], checks: dict[str, callable], line: str = "line") -> DataFrame:
    """Read ``line`` as ``columns`` and validate it: adds ``values`` (struct of strings), ``reason``, ``offset``.

    ``reason`` is null for a valid record, the fault of the tokenizer, or ``invalid_<column>`` of the first column, in
    the order of ``columns``, whose check fails; ``offset`` is then null. ``checks`` maps a column to a function from
    a lookup of trimmed values to a boolean column that is true when valid.
    """
    parsed = split_records(df, line, len(columns), "_rec")
    index = {c: i for i, c in enumerate(columns)}
    trimmed = lambda c: F.regexp_replace(F.get(F.col("_rec.fields"), F.lit(index[c])), r"(?U)^\s+|\s+$", "")
    bad = F.coalesce(*[F.when(~checks[c](trimmed), F.lit(f"invalid_{c}")) for c in columns if c in checks], F.lit(None).cast("string"))
    reason = F.coalesce(F.col("_rec.reason"), bad)
    return parsed.select(
        *[F.col(c) for c in df.columns],
        F.struct(*[F.get(F.col("_rec.fields"), F.lit(i)).alias(c) for c, i in index.items()]).alias("values"),
        reason.alias("reason"),
        F.col("_rec.offset").alias("offset"),
    )


#: The annotation columns and their vocabularies.
MACHINE_COLUMNS = ("id", "chapter", "form", "german_pp", "german_head_lemma", "german_sentence", "english_context", "english_context_provenance", "chinese_context", "chinese_context_provenance", "row_hash")
ANNOTATOR_COLUMNS = ("de_valid", "de_corrected_lemma", "de_exclusion_reason", "de_notes", "en_counterpart", "en_form", "en_alignment_confidence", "en_notes", "zh_counterpart", "zh_form", "zh_alignment_confidence", "zh_notes")
ANNOTATION_COLUMNS = [*MACHINE_COLUMNS, *ANNOTATOR_COLUMNS]
EXCLUSION_REASONS = ("not_target_pp", "not_definite", "extraction_error", "duplicate", "other")
EN_FORMS = ("definite", "bare_singular", "demonstrative", "indefinite", "possessive", "pronoun", "proper_name", "other", "omitted", "uncertain")
ZH_FORMS = ("bare", "demonstrative", "numeral_classifier", "possessive", "pronoun", "proper_name", "other", "omitted", "uncertain")
CONFIDENCES = ("high", "medium", "low", "not_aligned")


def _one_of(column: str, values: tuple[str, ...], blank: bool):
    return lambda v: v(column).isin(*values, *([""] if blank else []))


ANNOTATION_CHECKS = {
    "chapter": lambda v: v("chapter").rlike(r"^0*[1-9][0-9]?$"),
    "form": _one_of("form", ("contracted", "uncontracted"), False),
    "row_hash": lambda v: v("row_hash").rlike(r"^[0-9a-f]{64}$"),
    "de_valid": _one_of("de_valid", ("include", "exclude"), True),
    "de_exclusion_reason": lambda v: F.when(v("de_valid") == "exclude", v("de_exclusion_reason").isin(*EXCLUSION_REASONS)).otherwise(v("de_exclusion_reason") == ""),
    "en_form": _one_of("en_form", EN_FORMS, True),
    "en_alignment_confidence": _one_of("en_alignment_confidence", CONFIDENCES, True),
    "zh_form": _one_of("zh_form", ZH_FORMS, True),
    "zh_alignment_confidence": _one_of("zh_alignment_confidence", CONFIDENCES, True),
}


def classify_annotations(records: DataFrame) -> DataFrame:
    """:func:`classify` for the 23 annotation columns; the header (line 1 of each file) is left out."""
    body = records.filter(~F.coalesce(F.col("line_no") == 1, F.lit(False)))
    return classify(body, ANNOTATION_COLUMNS, ANNOTATION_CHECKS)
