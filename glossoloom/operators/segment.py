"""Sentences with deterministic ids by the fixed rules of a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as X

#: Stand-ins for masked stops, from the private use area.
_STOP, _DOTS, _ELLIPSIS = "\ue000", "\ue001", "\ue002"
#: Quotation marks of the Chinese rule; straight marks open and close.
QUOTES = {"“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", '"': '"', "'": "'"}
ENDS = "。！？"
CUT = r"(?<=[.!?])(?=\s|$)|(?<=[.!?][\"')\]»«])(?=\s|$)"


def split_spaced(text, abbreviations: tuple[str, ...] = ()) -> Column:
    """Sentences of an English or German text, as an array; stops of abbreviations and ellipses end nothing."""
    masked = F.regexp_replace(C.col(text), r"(?U)(\.\s+){2,}\.", "…")
    masked = F.replace(F.replace(masked, F.lit("..."), F.lit(_DOTS)), F.lit("…"), F.lit(_ELLIPSIS))
    for a in sorted(abbreviations, key=lambda a: (-len(a), a)):
        masked = F.replace(masked, F.lit(a), F.lit(a.replace(".", _STOP)))
    restore = lambda p: F.replace(F.replace(F.replace(p, F.lit(_STOP), F.lit(".")), F.lit(_DOTS), F.lit("...")), F.lit(_ELLIPSIS), F.lit("…"))
    parts = F.transform(F.split(masked, rf"(?U){CUT}"), lambda p: C.strip(restore(p)))
    return F.filter(parts, C.has_word)


def split_han_text(text: str) -> list[str]:
    """Sentences of a Chinese text: cut at ends outside quotations, or where an outermost quotation closes on an end."""
    parts, begin, stack = [], 0, []
    for i, c in enumerate(text):
        if stack and QUOTES[stack[-1]] == c:
            stack.pop()
            done = not stack and text[max(begin, i - 1) : i] != "" and text[i - 1] in ENDS
        elif c in QUOTES:
            stack.append(c)
            done = False
        else:
            done = c in ENDS and not stack
        if done:
            parts.append(text[begin : i + 1].strip())
            begin = i + 1
    parts.append(text[begin:].strip())
    out: list[str] = []
    marks = set(QUOTES) | set(QUOTES.values())
    for p in filter(None, parts):
        speech = len(p) <= 8 and not marks & set(p) and p[-1] in ENDS + "…" and any(v in p for v in X.SPEECH_VERBS) and any("一" <= c <= "鿿" for c in p)
        if speech and out and out[-1][-1] in QUOTES.values():
            out[-1] += p
        else:
            out.append(p)
    return [p for p in out if any("一" <= c <= "鿿" for c in p)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_han(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else split_han_text(t))


def segments_of(paragraphs: DataFrame, abbreviations: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, book, lang, chapter, paragraph, sentence, text, source_pages) of paragraphs; ordinals count kept sentences from 1.

    Null texts give none. Chinese takes the quotation rule in an Arrow batch, other languages stay in the JVM.
    """
    known = abbreviations or {}
    columns = ["book", "lang", "chapter", "paragraph", "source_pages"]
    spaced = F.lit(None).cast("array<string>")
    for lang in sorted(known):
        spaced = F.when(F.col("lang") == lang, split_spaced("text", known[lang])).otherwise(spaced)
    others = split_spaced("text")
    latin = paragraphs.filter("lang <> 'zh' AND text IS NOT NULL").select(*columns, F.coalesce(spaced, others).alias("parts"))
    han = paragraphs.filter("lang = 'zh' AND text IS NOT NULL").select(*columns, split_han("text").alias("parts"))
    rows = latin.unionByName(han).select(*columns, F.posexplode("parts").alias("_i", "text")).withColumn("sentence", F.col("_i") + 1).drop("_i")
    return rows.withColumn("id", C.segment_id("book", "lang", "chapter", "paragraph", "sentence"))
