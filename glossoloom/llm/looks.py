"""One consistent form for text that looks the same.

A mapping is computed once from rules and checked for conflicts: widths, composed accents, kinds of space, invisible
characters, letters of other scripts of the same look, radicals and ligatures. Its keys are single characters and
sequences of a letter with its accents. It is compiled to a transducer that reads grapheme clusters, longest match
first, in one pass; text between such clusters is its own image. Case, marks, other accents, numbers and line breaks stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from functools import cache, lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Letters of Cyrillic, Greek and Armenian that look like the Latin letters below them.
LOOK_ALIKE_FROM = "аеорсухіјѕһԁԛԝѵАВЕКМНОРСТХІЈЅԚԜνοαρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳօսոհցՕՍՏ"
LOOK_ALIKE_TO = "aeopcyxijshdqwvABEKMHOPCTXIJSQWvoapkABEZHIKMNOPTYXcjounhgOUS"
#: Code points without any visible form.
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0))
#: Spaces that differ from U+0020 in kind only.
SPACES = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
#: Blocks whose compatibility form looks the same (radicals, ligatures, full-width and half-width letters, small
#: Roman numerals, upright sans-serif and monospace letters and digits).
SAME_LOOK_BLOCKS = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9D), (0x2160, 0x217F), (0x1D5A0, 0x1D5D3), (0x1D670, 0x1D6A3), (0x1D7E2, 0x1D7EB), (0x1D7F6, 0x1D7FF))
#: Characters that are surely their own image, in the notation of both Python and Java: texts of nothing else
#: need no work. Checked against the mapping when it is compiled.
PLAIN = "\\x00-\\x9f\\xa1-\\xac\\xae-\\xff–-…、-〩㐀-䶿一-鿿！-／：-＠"


class MappingConflict(ValueError):
    pass


def add_entry(table: dict[str, str], key: str, image: str) -> None:
    """Enter a key; a second image for it is a conflict. What is its own image needs no entry."""
    if key != image and table.setdefault(key, image) != image:
        raise MappingConflict(f"{key!r} maps to {table[key]!r} and {image!r}")


@cache
def mapping() -> dict[str, str]:
    """Single code points to their form; no image holds a key, so one pass is enough."""
    out: dict[str, str] = {}
    for i in INVISIBLE:
        add_entry(out, chr(i), "")
    for i in SPACES:
        add_entry(out, chr(i), " ")
    if len(LOOK_ALIKE_FROM) != len(LOOK_ALIKE_TO):
        raise MappingConflict("the look-alike rows differ in length")
    for a, b in zip(LOOK_ALIKE_FROM, LOOK_ALIKE_TO):
        add_entry(out, a, b)
    for lo, hi in SAME_LOOK_BLOCKS:
        for i in range(lo, hi + 1):
            add_entry(out, chr(i), unicodedata.normalize("NFKC", chr(i)))
    for i in [*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        add_entry(out, chr(i), unicodedata.normalize("NFC", chr(i)))
    for key, image in list(out.items()):
        if any(c in out for c in image):
            raise MappingConflict(f"the image of {key!r} is mapped again")
    return out


def define(cluster: str) -> str:
    """What a cluster is to become: its parts mapped one by one, and composed again. The transducer is compiled from this."""
    table = mapping()
    return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", cluster)))


@cache
def sequences() -> dict[str, str]:
    """The whole mapping: single characters, and letters with accents in every look-alike and partly composed spelling."""
    out = dict(mapping())
    alike = defaultdict(list)
    for a, b in mapping().items():
        if len(b) == 1 and b.isalpha():
            alike[b].append(a)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c in out or not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        parts = unicodedata.normalize("NFD", c)
        add_entry(out, c, define(c))
        if len(parts) == 1 or not all(unicodedata.combining(p) for p in parts[1:]):
            continue
        image = define(parts)
        for base in {parts[0], *alike[parts[0]]}:
            add_entry(out, base + parts[1:], image)
            for k in range(2, len(parts)):  # the first accents composed with the letter, the others not
                add_entry(out, unicodedata.normalize("NFC", base + parts[1:k]) + parts[k:], image)
    return out


class Transducer:
    """Longest-match transducer of a table of strings: states are prefixes of its keys, an end state has an image."""

    def __init__(self, table: dict[str, str]):
        self.steps: list[dict[str, int]] = [{}]
        self.images: list[str | None] = [None]
        for key in sorted(table):
            state = 0
            for c in key:
                if c not in self.steps[state]:
                    self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    self.images.append(None)
                state = self.steps[state][c]
            self.images[state] = table[key]

    def read(self, text: str) -> list[tuple[str, str]]:
        """(matched, image) parts of a text, the longest match at each place; a character without a match is its own image."""
        out, i, n = [], 0, len(text)
        while i < n:
            state, best, j = 0, None, i
            while j < n and (state := self.steps[state].get(text[j], -1)) >= 0:
                j += 1
                if self.images[state] is not None:
                    best = j, self.images[state]
            end, image = best or (i + 1, text[i])
            out.append((text[i:end], image))
            i = end
        return out


@cache
def transducer() -> Transducer:
    return Transducer(sequences())


@cache
def _marks() -> frozenset[str]:
    return frozenset(c for i in range(sys.maxunicode + 1) if unicodedata.category(c := chr(i))[0] == "M")


def _ranges(codes: set[int]) -> str:
    """A character class of code points."""
    out, ordered = [], sorted(codes)
    start = last = ordered[0]
    for i in [*ordered[1:], None]:
        if i is not None and i == last + 1:
            last = i
            continue
        out.append(re.escape(chr(start)) + ("" if start == last else "-" + re.escape(chr(last))))
        start = last = i
    return "".join(out)


@cache
def _worked() -> str:
    """Class of the characters that make a cluster need work: first ones of single keys, and accents."""
    single = {ord(k) for k in sequences() if len(k) == 1}
    plain = re.compile(f"[{PLAIN}]")
    if any(plain.match(chr(i)) for i in single):
        raise MappingConflict("a plain character is mapped")
    return _ranges(single | set(map(ord, _marks())))


@cache
def _cluster_pattern() -> re.Pattern:
    """A run of characters that need work with the letter it may combine with. The soft hyphen before a line break shows."""
    return re.compile(f"(?:[^\\n{_worked()}])?(?:(?!\xad\\n)[{_worked()}])+")


@cache
def _plain_pattern() -> re.Pattern:
    return re.compile(f"[{PLAIN}]*+")


def is_plain(text: str) -> bool:
    """Is every character its own image, as a glance tells? False does not say that any is not."""
    return text.isascii() or _plain_pattern().match(text).end() == len(text)


def _image(cluster: str) -> str:
    """The transducer's image of a cluster. Accents that are left over combine with what stands before them: such a cluster,
    in none of the table's spellings, is computed from the rule the table comes from."""
    parts = transducer().read(cluster)
    image = "".join(x for _, x in parts)
    return image if not any(key in _marks() for key, _ in parts) else define(cluster)


_remembered = lru_cache(1 << 16)(_image)


def same_look(text: str | None) -> str | None:
    """The consistent form of a text; applying it twice changes nothing. Null stays null, empty stays empty."""
    if not text or is_plain(text):
        return text
    text = _cluster_pattern().sub(lambda m: _remembered(m.group()) if len(m.group()) < 16 else _image(m.group()), text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@F.pandas_udf(T.StringType())
def same_look_udf(texts: pd.Series) -> pd.Series:
    return texts.map(same_look)


def form_of(text):
    """Column with the consistent form of ``text``; texts of plain characters never leave the JVM."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(same_look_udf(F.when(column.rlike(f"[^{PLAIN}]"), column)), column)


def normalize_texts(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """Add ``out``, the consistent form of ``text``. Every row comes out once; an existing ``out`` is replaced."""
    return df.withColumn(out, form_of(text))


def equal_looking_pairs(records: DataFrame, group: list[str], key: str = "rec_id", text: str = "text") -> DataFrame:
    """Distinct (*group, id_a, id_b) of different records of one group that look the same but differ in characters.

    Null and empty texts take no part; a record delivered with several texts counts with each; repeated rows count
    once; null group values are equal to each other. Each distinct text is normalized once, the forms are written once,
    and only texts of equal form and different characters are joined, so copies of one text are never compared with
    each other.
    """
    distinct = records.filter(F.length(text) > 0).select(*group, F.col(key).alias("_id"), F.col(text).alias("_text")).distinct()
    # digests stand for texts and forms, so that no text is shuffled by the joins below
    digest = lambda c: F.unhex(F.sha2(c, 256))
    forms = materialize(distinct.select(*group, "_id", digest(F.col("_text")).alias("_text"), digest(form_of("_text")).alias("_form")), "p3-forms")
    several = forms.select(*group, "_form", "_text").distinct().groupBy(*group, "_form").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")

    def join(left: DataFrame, right: DataFrame, how: str, extra=F.lit(True)) -> DataFrame:
        """Null-safe equi-join on the group and the form that keeps the left copy of the keys."""
        renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in [*group, "_form"]})
        return left.join(renamed, reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in [*group, "_form"]], extra), how)

    wanted = join(forms, several, "left_semi")
    both = join(wanted, wanted.withColumnsRenamed({"_text": "_other", "_id": "_b"}), "inner", (F.col("_text") < F.col("_other")) & (F.col("_id") != F.col("_b")))
    return both.select(*group, F.least("_id", "_b").alias("id_a"), F.greatest("_id", "_b").alias("id_b")).distinct()


def corpus_records(segments: DataFrame, ocr_blocks: DataFrame) -> DataFrame:
    """Texts of both tables: (rec_table, book, lang, chapter, rec_id, text). Deleted rows count; a segment id of another
    form has an empty book and language and a null chapter, and is compared with its like."""
    parts = lambda i: F.regexp_extract("id", r"^(.+)_([a-z]+)_ch(\d+)_", i)
    return segments.select(
        F.lit("segment").alias("rec_table"), parts(1).alias("book"), parts(2).alias("lang"), F.expr(r"try_cast(regexp_extract(id, '^.+_[a-z]+_ch(\\d+)_', 1) AS int)").alias("chapter"), F.col("id").alias("rec_id"), "text"
    ).unionByName(ocr_blocks.select(F.lit("block").alias("rec_table"), "book", "lang", "chapter", F.col("block_id").alias("rec_id"), "text"))
