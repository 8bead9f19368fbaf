"""From scanned blocks to paragraphs: filters, page statistics and paragraph assembly, without a Python fold."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as X

#: A page belongs to a chapter of a book in one language.
CHAPTER = ["book", "lang", "chapter"]


def span_notes(blocks: DataFrame, marker_max: float, note_max: float) -> DataFrame:
    """Split small-print notes off: adds ``text`` without markers and ``notes`` array<string>.

    A marker is a span of one or two digits below ``marker_max``. A line with a marker whose other spans are all below
    ``note_max`` is a note; other lines lose their markers. Small print without a marker stays in the body, and blocks
    without spans pass unchanged.
    """
    marker = lambda s: (s["size"] < marker_max) & F.trim(s["text"]).rlike(r"^\d{1,2}$")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), "")
    rest = lambda line: F.filter(line["spans"], lambda s: ~marker(s))
    note = lambda line: F.exists(line["spans"], marker) & (F.size(rest(line)) > 0) & F.forall(rest(line), lambda s: s["size"] < note_max)
    has = F.coalesce(F.size("lines"), F.lit(0)) > 0
    body = F.array_join(F.transform(F.filter("lines", lambda x: ~note(x)), lambda x: joined(rest(x))), "\n")
    notes = F.filter(F.transform(F.filter("lines", note), lambda x: F.regexp_replace(C.normalize_block(joined(rest(x))), r"^[　 ]+|[　 ]+$", "")), lambda t: t != "")
    return blocks.withColumn("notes", F.when(has, notes).otherwise(F.array().cast("array<string>"))).withColumn("text", F.when(has, body).otherwise(F.col("text")))


def marker_count(marker_max: float) -> Column:
    """Spans of a block that are markers of notes."""
    spans = F.flatten(F.transform("lines", lambda x: F.coalesce(x["spans"], F.array().cast("array<struct<text:string,size:double,flags:int>>"))))
    return F.coalesce(F.size(F.filter(spans, lambda s: (s["size"] < marker_max) & F.trim(s["text"]).rlike(r"^\d{1,2}$"))), F.lit(0))


def valid_box() -> Column:
    return (F.size("bbox") >= 4) & (F.get("bbox", F.lit(2)) > F.get("bbox", F.lit(0))) & (F.get("bbox", F.lit(0)) > 0)


def mark_outliers(blocks: DataFrame, factor: float = 3.0) -> DataFrame:
    """Add ``outlier``: a recognised block whose left edge is beyond ``factor`` times the page's upper median."""
    page = W.partitionBy(*CHAPTER, "page")
    x0 = F.get("bbox", F.lit(0))
    median = C.upper_median(F.collect_list(F.when(valid_box(), x0)).over(page))
    return blocks.withColumn("outlier", F.coalesce((F.col("engine") == "paddleocr") & valid_box() & (x0 > factor * median), F.lit(False)))


def page_thresholds(blocks: DataFrame) -> DataFrame:
    """(*CHAPTER, page, margin, threshold): left margin and indent threshold of each page.

    The margin is the tenth percentile of left edges by rounded rank; the threshold is the middle of the largest gap
    of at least 30 between distinct left edges up to 2.5 margins, else the margin plus 50.
    """
    x0 = F.get("bbox", F.lit(0))
    pages = blocks.filter(F.size("bbox") >= 4).groupBy(*CHAPTER, "page").agg(
        F.array_sort(F.collect_list(x0)).alias("xs"), F.array_sort(F.collect_set(F.when(valid_box(), x0))).alias("us")
    )
    pages = pages.withColumn("margin", F.element_at("xs", (F.bround(0.1 * (F.size("xs") - 1)) + 1).cast("int")))
    body = F.filter("us", lambda x: x <= 2.5 * F.col("margin"))
    gaps = F.zip_with(F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0))), F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), lambda a, b: F.struct((b - a).alias("gap"), (-a).alias("neg")))
    best = F.array_max(gaps)
    threshold = F.when(best["gap"] >= 30, -best["neg"] + best["gap"] / 2).otherwise(F.col("margin") + 50)
    return pages.select(*CHAPTER, "page", "margin", F.when(F.size("us") > 0, threshold).alias("threshold"))


def block_reason(headers: list[str], min_confidence: float = 0.4, footnote_markers: bool = False) -> Column:
    """Why a normalized block leaves the body, null if it stays; reasons in the order of the pipeline."""
    squeezed = C.squeeze("norm")
    header = squeezed.isin(*[h.replace(" ", "").replace("　", "") for h in headers]) if headers else F.lit(False)
    return (
        F.when(F.col("outlier"), "outlier")
        .when(F.length("norm") == 0, "empty")
        .when(F.col("confidence") < min_confidence, "low_confidence")
        .when(F.lit(footnote_markers) & F.col("norm").rlike("^[①-⑩]"), "footnote")
        .when(header, "header")
        .when(C.strip("norm").rlike(r"^\d{1,4}$"), "page_number")
        .when(F.col("norm").rlike(rf"(?U)^[{X.ORNAMENTS}\s]+$"), "decorative")
        .when(C.strip("norm").rlike(r"^\p{L}$"), "single_letter")
    )


def classify_blocks(blocks: DataFrame, headers: list[str] = (), min_confidence: float = 0.4, footnote_markers: bool = False) -> DataFrame:
    """Add ``norm`` and ``reason`` to blocks; null texts count as empty."""
    ready = mark_outliers(blocks).withColumn("norm", F.coalesce(C.normalize_block("text"), F.lit("")))
    return ready.withColumn("reason", block_reason(list(headers), min_confidence, footnote_markers))


def first_loaded(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """The first delivered row of each key, by ``loaded_at``, then by ``ties``."""
    order = W.partitionBy(key).orderBy("loaded_at", *ties)
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def title_letters(c) -> Column:
    """Letters of a line without case, blanks, numbers and marks: equal for a title, its capitals and its letter-spaced form."""
    return F.lower(F.regexp_replace(C.col(c), r"[^\p{L}]", ""))


def running_titles(blocks: DataFrame, pages: int = 2) -> DataFrame:
    """(book, lang, title): title_letters of single lines that stand on ``pages`` pages or more of a book.

    A title begins with a capital or a Han letter, has three letters or more and no sentence mark, and no digit but a
    number beside it.
    """
    line = C.strip("text")
    bare = F.regexp_replace(line, r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$", "")
    plain = ~line.contains("\n") & bare.rlike(r"^[\p{Lu}\p{IsHan}]") & ~bare.rlike(r"[.!?,;:…。！？，；：、“”„»«「」()（）\d-]")
    rows = blocks.filter(plain).select("book", "lang", "chapter", "page", title_letters("text").alias("title")).filter(F.length("title") >= 3)
    return rows.groupBy("book", "lang", "title").agg(F.count_distinct("chapter", "page").alias("n")).filter(F.col("n") >= pages).drop("n")


def mark_titles(classified: DataFrame, titles: DataFrame) -> DataFrame:
    """Kept single-line blocks that are a running title of their book get the reason ``header``; see :func:`running_titles`."""
    known = titles.select(*[F.col(c).alias(f"_{c}") for c in ("book", "lang", "title")])
    same = F.col("book").eqNullSafe(F.col("_book")) & F.col("lang").eqNullSafe(F.col("_lang")) & (title_letters("text") == F.col("_title"))
    rows = classified.join(known, same, "left")
    hit = F.col("_title").isNotNull() & ~C.strip("text").contains("\n")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & hit, "header").otherwise(F.col("reason"))).drop("_book", "_lang", "_title")


def assemble_paragraphs(blocks: DataFrame, opening_quotes: dict[str, str] | None = None, text: str = "norm") -> DataFrame:
    """Paragraphs of kept blocks: (*CHAPTER, paragraph, text, page, source_pages).

    Whether a block opens a paragraph depends only on it and on the block before, so a lag and a running sum do what
    is a fold over the blocks; texts are then joined in order. A break by hyphen before a small letter is healed.
    """
    quotes = opening_quotes or {}
    order = W.partitionBy(*CHAPTER).orderBy("page", "block_idx", "block_id")
    stripped = C.strip(text)
    rows = blocks.withColumn("_indent3000", F.col(text).startswith("　")).withColumn("_t", stripped).filter(F.length("_t") > 0)
    pages = F.map_from_entries(F.collect_list(F.struct("page", "threshold")))  # by chapter, as the windows go, so texts are shuffled once
    rows = rows.join(page_thresholds(blocks).filter("page IS NOT NULL").groupBy(*CHAPTER).agg(pages.alias("_pages")), CHAPTER, "left").withColumn("threshold", F.try_element_at("_pages", F.col("page"))).drop("_pages")
    before = F.lag("_t").over(order)
    x0 = F.get("bbox", F.lit(0))
    indented = F.col("_indent3000") | F.when(F.col("threshold").isNotNull() & valid_box(), x0 > F.col("threshold")).otherwise(F.col(text).startswith("    "))
    quote = F.coalesce(*[F.when(F.col("lang") == k, F.col("_t").startswith(q)) for k, q in quotes.items()], F.lit(False))
    opens = before.isNull() | F.coalesce(indented, F.lit(False)) | (C.ends_sentence(before) & (quote | (F.col("lang") == "en")))
    heal = before.endswith("-") & F.col("_t").rlike(r"^\p{Ll}")
    rows = rows.withColumn("_open", opens).withColumn("_glue", F.when(heal, "-").when(F.col("lang").isin("en", "de"), " ").otherwise(""))
    rows = rows.withColumn("paragraph", F.sum(F.col("_open").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("page", "block_idx", "block_id", "_t", "_glue")))
    return rows.groupBy(*CHAPTER, "paragraph").agg(parts.alias("_p"), F.min("page").alias("page"), F.array_sort(F.collect_set("page")).alias("source_pages")).withColumn(
        "text", C.strip(F.regexp_replace(F.aggregate("_p", F.lit(""), lambda s, p: F.when(s == "", p["_t"]).when(p["_glue"] == "-", F.concat(F.regexp_replace(s, "-$", ""), p["_t"])).otherwise(F.concat(s, p["_glue"], p["_t"]))), r"(?U)\s+", " "))
    ).drop("_p")


def clean(blocks: DataFrame, *, first_page: int | None = None, last_page: int | None = None, headers: list[str] = (), min_confidence: float = 0.4, footnote_markers: bool = False, notes: tuple[float, float] | None = None, opening_quotes: dict[str, str] | None = None) -> DataFrame:
    """The whole cleaning in its fixed order: range, span notes, outliers, normalization, filters, assembly."""
    rows = blocks
    if first_page is not None:
        rows = rows.filter(F.col("page").between(first_page, last_page))
    if notes:
        rows = span_notes(rows, *notes).filter(F.length(F.trim("text")) > 0)
    return assemble_paragraphs(classify_blocks(rows, headers, min_confidence, footnote_markers).filter("reason IS NULL"), opening_quotes)


def confidence_summary(blocks: DataFrame, by: list[str], low: float = 0.6) -> DataFrame:
    """Count, mean, upper median, low decile and number below ``low`` of recognition confidences.

    Equal confidences are counted first; places in the order are then found from running counts, so no group is gathered.
    """
    counts = blocks.filter(F.col("confidence").isNotNull()).groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*by)
    upto = F.sum("_c").over(group.orderBy("confidence").rowsBetween(W.unboundedPreceding, 0))
    rows = counts.withColumns({"_upto": upto, "_all": F.sum("_c").over(group)})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("confidence")))
    decile = F.greatest(F.lit(0), F.floor(0.1 * F.col("_all")) - 1)
    mean = F.sum(F.col("confidence") * F.col("_c")) / F.sum("_c")
    known = rows.groupBy(*by).agg(F.sum("_c").alias("n"), mean.alias("mean"), at(F.floor(F.col("_all") / 2)).alias("median"), at(decile).alias("p10"), F.coalesce(F.sum(F.when(F.col("confidence") < low, F.col("_c"))), F.lit(0)).alias("low"))
    every = blocks.select(*by).distinct()  # groups without any confidence have none of the figures
    met = every.join(known.withColumnsRenamed({c: f"_{c}" for c in by}), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left")
    return met.drop(*[f"_{c}" for c in by]).fillna(0, ["n", "low"])


def wordlist(texts: DataFrame, text: str = "text", minimum: int = 2) -> DataFrame:
    """Words that occur at least ``minimum`` times, each also in lower case: (word)."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÄÖÜäöüß]+"), F.lit(0))).alias("word"))
    kept = words.groupBy("word").count().filter(F.col("count") >= minimum)
    return kept.select(F.explode(F.array("word", F.lower("word"))).alias("word")).distinct()


def split_stuck_words(df: DataFrame, known: DataFrame, text: str = "text", out: str = "split") -> DataFrame:
    """Separate words that scanning stuck together, token by token; ``known`` holds the known words (word), of any number.

    A token is cut where both parts are plausible: a known word, or a capitalized word of three letters or more.
    Function words at its ends are tried first, longest first, then a capital inside, then the most balanced cut.
    The parts of each distinct token are looked up by a join; a token is decided by those of them that are known.
    """

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        from ..functions.stuck import tokens_of

        return pd.Series([sorted(tokens_of(t)) if t else [] for t in texts], dtype=object)

    def parts(batches):
        from ..functions.stuck import parts_of

        for pdf in batches:
            for i in range(0, len(pdf), 500):
                yield pd.DataFrame([(t, p) for t in pdf.token[i : i + 500] for p in parts_of(t)], columns=["token", "word"])

    @F.pandas_udf("string")
    def separate(names: pd.Series, words: pd.Series) -> pd.Series:
        from ..functions.stuck import split_token

        return pd.Series([" ".join(split_token(t, frozenset(() if w is None else w))) for t, w in zip(names, words)], dtype=object)

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, changes: pd.Series) -> pd.Series:
        from ..functions.stuck import replace_tokens

        known_changes = [{} if c is None else {x["token"]: x["parts"] for x in c} for c in changes]
        return pd.Series([t if not c else replace_tokens(t, lambda w, c=c: c.get(w, w)) for t, c in zip(texts, known_changes)], dtype=object)

    named = df.select(F.col(text).alias("_text")).distinct().select("_text", F.explode(tokens("_text")).alias("token"))
    distinct = named.select("token").distinct()
    found = distinct.mapInPandas(parts, "token string, word string").join(known.select("word").distinct(), "word").groupBy("token").agg(F.collect_set("word").alias("words"))
    cut = distinct.join(found, "token", "left").select("token", separate("token", "words").alias("parts")).filter("parts <> token")
    changes = named.join(cut, "token").groupBy("_text").agg(F.collect_list(F.struct("token", "parts")).alias("_changes"))
    return df.join(changes, F.col(text) == F.col("_text"), "left").withColumn(out, replaced(F.col(text), "_changes")).drop("_text", "_changes")
