"""Column builders: identities, hashes, text and number functions, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as X

UNIT = "\x1f"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- identities ---------------------------------------------------------------------------------------------------


def segment_id(book, lang, chapter, paragraph, sentence) -> Column:
    return F.format_string("%s_%s_ch%02d_p%04d_s%03d", *[col(c) for c in (book, lang, chapter, paragraph, sentence)])


def segment_parts(c) -> dict[str, Column]:
    """book, lang, chapter, paragraph, sentence of a segment id; null where the id is malformed."""
    ok = col(c).rlike(X.SEGMENT_ID)
    part = lambda i: F.when(ok, F.regexp_extract(col(c), r"^([a-z0-9]+)_([a-z]+)_ch(\d{2})_p(\d{4})_s(\d{3})$", i))
    return {"book": part(1), "lang": part(2), "chapter": part(3).cast("int"), "paragraph": part(4).cast("int"), "sentence": part(5).cast("int")}


def scope_of(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^([a-z0-9]+_[a-z]+_ch\d{2})_", 1), F.lit(""))


def block_id(segment, ordinal) -> Column:
    return F.format_string("%s#b%03d", col(segment), col(ordinal))


def block_parts(c) -> dict[str, Column]:
    ordinal = F.expr(f"try_cast(regexp_extract({c}, '^(.+)#b([0-9]{{3,}})$', 2) AS int)")
    return {"segment": F.when(ordinal >= 1, F.regexp_extract(col(c), r"^(.+)#b(\d{3,})$", 1)), "ordinal": F.when(ordinal >= 1, ordinal)}


def datapoint_id(chapter, block, start, end) -> Column:
    return F.format_string("dp_ch%02d_%s_t%d-%d", col(chapter), col(block), col(start), col(end))


def canonical_prep(c) -> Column:
    """Contraction to canonical preposition; other words pass."""
    table = F.create_map(*[F.lit(x) for kv in X.CONTRACTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(c)), col(c))


def minimal_pair(prep, lemma) -> Column:
    return F.concat(col(prep), F.lit("|"), col(lemma))


def cardinality(src, tgt) -> Column:
    n = lambda c: F.coalesce(F.size(col(c)), F.lit(0)).cast("string")
    return F.concat(n(src), F.lit(":"), n(tgt))


def python_json_list(c) -> Column:
    """A list of strings as JSON text with a blank after each comma."""
    return F.concat(F.lit('["'), F.array_join(col(c), '", "'), F.lit('"]'))


def row_hash(columns: list[str], types: dict[str, str]) -> Column:
    """SHA-256 of ``name=value`` joined by the unit separator; booleans as true/false, null as nothing, lists as JSON."""
    def text(c: str) -> Column:
        kind = types[c]
        v = F.when(F.size(c) == 0, F.lit("[]")).otherwise(python_json_list(c)) if kind.startswith("array") else F.col(c).cast("string")
        return F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit("")))

    return F.sha2(F.concat_ws(UNIT, *[text(c) for c in columns]), 256)


def ordered_digest(items: Column) -> Column:
    """SHA-256 over the items of an ordered array, each followed by the unit separator."""
    return F.sha2(F.concat_ws("", F.transform(items, lambda x: F.concat(x, F.lit(UNIT)))), 256)


# --- text ---------------------------------------------------------------------------------------------------------


def squeeze(c) -> Column:
    """Text without any white space."""
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_block(c) -> Column:
    """Block text on one line: C1 controls dropped, breaks within words healed, one leading U+3000 kept."""
    plain = F.regexp_replace(col(c), r"[\x7f-\x9f]", "")
    prefix = F.when(plain.startswith("　"), F.lit("　")).otherwise(F.lit(""))
    healed = F.regexp_replace(plain, r"([A-Za-zÄÖÜäöüß])-[\n\r]+([a-zäöüß])", "$1$2")
    return F.concat(prefix, strip(F.regexp_replace(healed, r"(?U)\s+", " ")))


def ends_sentence(c) -> Column:
    """Does the text end in a sentence terminator? Empty text does."""
    last = F.substring(F.regexp_replace(col(c), r"(?U)\s+$", ""), -1, 1)
    return (F.length(col(c)) == 0) | (F.instr(F.lit(X.TERMINATORS), last) > 0) & (last != "")


def has_han(c) -> Column:
    return col(c).rlike(r"[一-鿿]")


def has_word(c) -> Column:
    return col(c).rlike(r"[\p{L}\p{N}]")


def excel_safe(c) -> Column:
    return F.when(col(c).rlike(r"^[=+\-@]"), F.concat(F.lit(" "), col(c))).otherwise(col(c))


def undersegmented(c) -> Column:
    """Does a German segment likely hold several sentences or turns?"""
    return (F.size(F.regexp_extract_all(col(c), F.lit(r"[.!?…]+"), F.lit(0))) >= 2) | (F.size(F.split(col(c), "»")) - 1 >= 2) | (F.length(col(c)) > 280)


def anchors_in(text, lexicon: dict[str, str | None]) -> Column:
    """Sorted anchors of a text: lexicon entries of which either side occurs, and distinctive numbers."""
    words = [F.when(F.contains(col(text), F.lit(a)) | (F.contains(col(text), F.lit(b)) if b else F.lit(False)), F.lit(a)) for a, b in lexicon.items()]
    numbers = F.filter(F.regexp_extract_all(col(text), F.lit(r"\d+(?:[.,/]\d+)*"), F.lit(0)), lambda x: (F.length(x) >= 2) | x.contains("/"))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*words)) if words else F.array().cast("array<string>"), numbers)))


def overlaps(a, b) -> Column:
    """Is one lower-cased text part of the other? Empty texts are part of nothing."""
    x, y = F.lower(F.trim(col(a))), F.lower(F.trim(col(b)))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def capitalized_tokens(c) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(col(c), r"\s+"), lambda t: t.rlike(r"^\p{Lu}")), lambda t: F.lower(t)))


# --- numbers ------------------------------------------------------------------------------------------------------


def dot(a, b) -> Column:
    """Dot product of two vectors; the cosine if they have unit length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def squashed_ratio(score, forward, backward) -> Column:
    """Score against the mean of the neighbours' means, squashed to (0, 1)."""
    r = col(score) / F.greatest((col(forward) + col(backward)) / 2, F.lit(1e-9))
    return r / (1 + r)


def length_prior(src_chars, tgt_chars, mu: float, tau: float, penalty: float) -> Column:
    """Penalty for a length ratio off ``mu`` by more than ``tau`` in logarithm; none for an empty side."""
    off = F.abs(F.log((col(src_chars) / col(tgt_chars)) / mu)) - tau
    return F.when((col(src_chars) > 0) & (col(tgt_chars) > 0), penalty * F.greatest(F.lit(0.0), off)).otherwise(0.0)


def extra_penalty(lengths) -> Column:
    """Sum over the sentences after the first of min(1, length / 60)."""
    rest = F.slice(col(lengths), 2, F.greatest(F.size(col(lengths)) - 1, F.lit(0)))
    return F.aggregate(rest, F.lit(0.0), lambda s, x: s + F.least(F.lit(1.0), x / 60))


def idf(total, df) -> Column:
    n = F.greatest(col(total), F.lit(2))
    return F.when(col(df) < n, F.least(F.lit(1.0), F.log(n / col(df)) / F.log(n))).otherwise(0.0)


def match_status(score) -> Column:
    return F.when(col(score) >= X.MATCHED, "matched").when(col(score) >= X.CANDIDATE, "candidate").otherwise("unmappable")


def verdict(ratio) -> Column:
    return F.when(col(ratio) >= 0.8, "same").when(col(ratio) >= 0.55, "changed").otherwise("different")


def percentage(part, whole) -> Column:
    return F.when(col(whole) > 0, F.round(100.0 * col(part) / col(whole), 1)).otherwise(0.0)


def bbox_of(points) -> Column:
    """[x0, y0, x1, y1] of a polygon of [x, y] points; four zeros for none."""
    xs, ys = F.transform(col(points), lambda p: p[0]), F.transform(col(points), lambda p: p[1])
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.coalesce(F.size(col(points)), F.lit(0)) > 0, box).otherwise(F.array(*[F.lit(0.0)] * 4))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted values."""
    s = F.array_sort(values)
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
