"""Dependency blocks: reading, provenance, multiword tokens and prepositional phrases, as expressions over token arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as X

FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
TOKENS = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))
_RANGE = r"^\d+-\d+$"


def parse_blocks(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``sent_id``, ``source_segment_id``, ``sent_text`` and ``out``: the token rows of one CoNLL-U block.

    Rows with fewer than eight columns or without a number as id are skipped; range rows stay.
    """
    lines = F.split(F.col(text), r"\r?\n")
    comment = lambda key: F.nullif(F.regexp_extract(F.col(text), rf"(?m)^#\s*{key}\s*=\s*(.*?)\s*$", 1), F.lit(""))
    cells = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d+(-\d+)?\t")), lambda x: F.split(x, "\t"))
    tokens = F.transform(F.filter(cells, lambda c: F.size(c) >= 8), lambda c: F.struct(*[F.coalesce(F.get(c, F.lit(i)), F.lit("_")).alias(f) for i, f in enumerate(FIELDS)]))
    return df.select("*", comment("sent_id").alias("sent_id"), comment("source_segment_id").alias("source_segment_id"), comment("text").alias("sent_text"), tokens.alias(out))


def document_blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of files held as texts: (key, ord, text), blocks being parted by blank lines; ord counts from 1."""
    parts = F.filter(F.split(F.col(text), r"\n[ \t]*\n+"), lambda b: b.rlike(r"\S"))
    return documents.select(key, F.posexplode(parts).alias("_i", "text")).select(key, (F.col("_i") + 1).alias("ord"), "text")


def words_only(tokens) -> Column:
    """Tokens without range rows."""
    return F.filter(C.col(tokens), lambda t: ~t["id"].rlike(_RANGE))


def number(c: Column) -> Column:
    return c.try_cast("int") if hasattr(c, "try_cast") else c.cast("int")


def surface(tokens, start, end) -> Column:
    """Forms from token ``start`` to ``end``, joined by blanks; range rows are skipped."""
    inside = F.filter(words_only(tokens), lambda t: number(t["id"]).between(C.col(start), C.col(end)))
    return F.array_join(F.transform(inside, lambda t: t["form"]), " ")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, which lambdas have no syntax for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_phrases(tokens, forms: tuple[str, ...], contracted: bool, determiners: tuple[str, ...] = X.DETERMINERS) -> Column:
    """Phrases of a block as array<struct<prep, det, noun, prep_token_id, det_token_id, noun_token_id, det_xpos, det_deprel>>.

    One pass over the tokens with a state: a form of the list opens a phrase (and leaves an earlier determiner as it
    is), an article with the same head becomes the determiner, and the head noun closes the phrase, if a determiner
    was found or the form is a contraction.
    """
    none = lambda kind: F.lit(None).cast(kind)
    hit = "struct<prep:string,det:string,noun:string,prep_token_id:int,det_token_id:int,noun_token_id:int,det_xpos:string,det_deprel:string>"
    start = F.struct(none("string").alias("head"), none("string").alias("prep"), none("int").alias("at"), none("string").alias("det"), none("int").alias("det_at"), none("string").alias("det_xpos"), none("string").alias("det_deprel"), F.array().cast(f"array<{hit}>").alias("out"))
    names = ("head", "prep", "at", "det", "det_at", "det_xpos", "det_deprel", "out")

    def changed(s, when, **new) -> Column:
        return F.struct(*[(F.when(when, new[n]).otherwise(s[n]) if n in new else s[n]).alias(n) for n in names])

    def step(s, t) -> Column:
        opens = t["form"].isin(*forms)
        one = changed(s, opens, head=t["head"], prep=t["form"], at=number(t["id"]))

        def second(s1):
            if contracted:
                return s1
            article = F.coalesce((t["head"] == s1["head"]) & (t["xpos"] == "ART") & t["form"].isin(*determiners), F.lit(False))
            return changed(s1, article, det=t["form"], det_at=number(t["id"]), det_xpos=t["xpos"], det_deprel=t["deprel"])

        def third(s2):
            closes = F.coalesce((t["id"] == s2["head"]) & (t["xpos"] == "NN"), F.lit(False)) & (F.lit(contracted) | s2["det"].isNotNull())
            found = F.struct(s2["prep"].alias("prep"), s2["det"].alias("det"), t["lemma"].alias("noun"), s2["at"].alias("prep_token_id"), s2["det_at"].alias("det_token_id"), number(t["id"]).alias("noun_token_id"), s2["det_xpos"].alias("det_xpos"), s2["det_deprel"].alias("det_deprel"))
            blank = {n: none("int" if n in ("at", "det_at") else "string") for n in names if n != "out"}
            return changed(s2, closes, **blank, out=F.concat(s2["out"], F.array(found.cast(hit))))

        return _let(_let(one, second), third)

    return F.aggregate(words_only(tokens), start, step, lambda s: s["out"])


def chunk_tags(tokens) -> Column:
    """Tokens with tags of a shallow chunker, for German words that came without: no model, only what the words show.

    Prepositions of the inventory and contractions are adpositions, articles determiners, and capitals after the
    first word nouns. Adpositions and determiners depend on the next noun as ``case`` and ``det``; where none follows, on
    nothing. Range rows go.
    """
    words = words_only(tokens)
    at = F.filter(F.transform(words, lambda t, i: F.when(t["form"].rlike(r"^\p{Lu}") & (i > 0), i + 1)), lambda i: i.isNotNull())

    def tag(t, i):
        small = F.lower(t["form"])
        adp, det, noun = small.isin(*X.PREPOSITIONS, *X.CONTRACTIONS), small.isin(*X.DEFINITE_ARTICLES), F.array_contains(at, i + 1)
        head = F.array_min(F.filter(at, lambda p: p > i + 1))
        new = {
            "id": (i + 1).cast("string"), "upos": F.when(noun, "NOUN").when(adp, "ADP").when(det, "DET").otherwise("X"), "xpos": F.when(noun, "NN").when(adp, "APPR").when(det, "ART").otherwise("XY"),
            "head": F.when(~noun & (adp | det), F.coalesce(head.cast("string"), F.lit("0"))).otherwise("0"), "deprel": F.when(noun, "root").when(adp, "case").when(det, "det").otherwise("dep"),
        }
        return F.struct(*[new.get(f, t[f]).alias(f) for f in FIELDS])

    return F.transform(words, tag)


def case_phrases(tokens) -> Column:
    """Every adposition marked as case, with its head and the head's close dependents: array of structs.

    Fields: prep_surface, prep_lemma, prep_token_id, head_surface, head_lemma, head_token_id, head_upos, span_text,
    span_token_ids. Trailing punctuation leaves the span; inner punctuation is joined without a blank.
    """
    words = words_only(tokens)
    preps = F.filter(words, lambda t: (t["upos"] == "ADP") & (t["deprel"] == "case") & F.exists(words, lambda h: h["id"] == t["head"]))

    def phrase(p):
        head = F.get(F.filter(words, lambda t: t["id"] == p["head"]), F.lit(0))
        members = F.filter(words, lambda t: (t["id"] == p["id"]) | (t["id"] == p["head"]) | (t["head"] == p["head"]) & t["deprel"].isin(*X.HEAD_MODIFIERS))
        kept_to = F.array_max(F.transform(F.filter(members, lambda t: t["upos"] != "PUNCT"), lambda t: number(t["id"])))
        span = F.filter(members, lambda t: number(t["id"]) <= kept_to)
        text = F.aggregate(span, F.lit(""), lambda s, t: F.when((s == "") | (t["upos"] == "PUNCT"), F.concat(s, t["form"])).otherwise(F.concat(s, F.lit(" "), t["form"])))
        return F.struct(p["form"].alias("prep_surface"), p["lemma"].alias("prep_lemma"), number(p["id"]).alias("prep_token_id"), head["form"].alias("head_surface"), head["lemma"].alias("head_lemma"), number(head["id"]).alias("head_token_id"), head["upos"].alias("head_upos"), text.alias("span_text"), F.transform(span, lambda t: number(t["id"])).alias("span_token_ids"))

    return F.transform(preps, phrase)


def collapse_ranges(tokens) -> Column:
    """Multiword tokens as one token: the range row gives the form, its first part the rest; others parts go.

    Tokens are renumbered from 1 and heads follow; a head that pointed to a part that went stays as it was.
    """
    ranges = F.transform(F.filter(C.col(tokens), lambda t: t["id"].rlike(_RANGE)), lambda t: F.struct(F.split(t["id"], "-")[0].cast("int").alias("a"), F.split(t["id"], "-")[1].cast("int").alias("b"), t["form"].alias("form")))
    words = words_only(tokens)
    inside = lambda t: F.exists(ranges, lambda r: (number(t["id"]) > r["a"]) & (number(t["id"]) <= r["b"]))
    kept = F.filter(words, lambda t: ~inside(t))
    ids = F.transform(kept, lambda t: t["id"])

    def renew(t, i):
        own = F.filter(ranges, lambda r: r["a"] == number(t["id"]))
        position = F.array_position(ids, t["head"])
        new = {"id": (i + 1).cast("string"), "form": F.coalesce(F.get(own, F.lit(0))["form"], t["form"]), "head": F.when(position > 0, position.cast("string")).otherwise(t["head"])}
        return F.struct(*[new.get(f, t[f]).alias(f) for f in FIELDS])

    return F.transform(kept, renew)


def block_text(sent_id, source, text, tokens) -> Column:
    """A block as CoNLL-U text with its three comments."""
    rows = F.transform(C.col(tokens), lambda t: F.concat_ws("\t", *[t[f] for f in FIELDS]))
    return F.concat_ws("\n", F.concat(F.lit("# sent_id = "), C.col(sent_id)), F.concat(F.lit("# source_segment_id = "), C.col(source)), F.concat(F.lit("# text = "), C.col(text)), F.array_join(rows, "\n"))


def number_blocks(blocks: DataFrame, file: str = "doc_id") -> DataFrame:
    """Add ``ordinal`` within the segment in document order and ``new_id``; ids that carry an ordinal are kept."""
    parts = C.block_parts("sent_id")
    segment = F.coalesce(parts["segment"], F.col("sent_id"))
    rows = blocks.withColumn("segment", segment).withColumn("given", parts["ordinal"])
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy(file, "segment").orderBy("ord")))
    return rows.withColumn("new_id", F.when(F.col("given").isNotNull(), F.col("sent_id")).otherwise(C.block_id("segment", "ordinal")))


def provenance_faults(blocks: DataFrame, file: str = "doc_id") -> DataFrame:
    """First fault of each block: orphan, unmigrated, missing source, prefix mismatch, duplicate, ordinal gap."""
    rows = number_blocks(blocks, file).withColumn("_copies", F.row_number().over(W.partitionBy(file, "sent_id").orderBy("ord")))
    rule = (
        F.when(F.col("sent_id").isNull(), "orphan_block")
        .when(F.col("given").isNull(), "unmigrated")
        .when(F.col("source_segment_id").isNull(), "missing_source")
        .when(F.col("source_segment_id") != F.col("segment"), "prefix_mismatch")
        .when(F.col("_copies") > 1, "duplicate")
        .when(F.col("given") != F.col("ordinal"), "ordinal_gap")
    )
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select(file, "ord", "sent_id", "rule")


def provenance_counts(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks, distinct ids, segments, segments of several blocks and the most blocks of one segment."""
    per = blocks.groupBy(*by, "source_segment_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sent_id").alias("ids"))
    return per.groupBy(*by).agg(F.sum("n").alias("blocks"), F.sum("ids").alias("ids"), F.count(F.lit(1)).alias("segments"), F.count_if(F.col("n") > 1).alias("multi_block"), F.max("n").alias("most"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def token_offsets(texts: pd.Series, forms: pd.Series) -> pd.Series:
    """[start, end] of each form in its text, searched from the end of the one before, whole words first; null if absent."""
    import re

    def locate(text: str, words) -> list:
        at, out = 0, []
        for w in words:
            m = re.compile(rf"\b{re.escape(w)}\b").search(text, at) if w else None
            start = m.start() if m else (text.find(w, at) if w else -1)
            out.append([start, start + len(w)] if start >= 0 else None)
            at = start + len(w) if start >= 0 else at
        return out

    return pd.Series([[] if t is None or f is None else locate(t, f) for t, f in zip(texts, forms)])
