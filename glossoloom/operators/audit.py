"""Reports over the corpus: quality checks, id impact, prefixes and stream differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as X
from ..functions import matching


def quality_issues(segments: DataFrame, short: int = 3, long: int = 1000) -> DataFrame:
    """(issue, id): repeated, empty, short, long, malformed and misplaced segments, and ids out of load order.

    Load order within a chapter stands for file order; ties are broken by id.
    """
    ok = F.col("id").rlike(X.SEGMENT_ID)
    parts = C.segment_parts("id")
    rows = segments.withColumn("_b", F.regexp_extract("id", r"^(.+?)_ch", 1)).withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("loaded_at")))
    order = W.partitionBy("_b", "chapter").orderBy("loaded_at", "id")
    place = F.when(ok, F.struct(parts["paragraph"].alias("p"), parts["sentence"].alias("s")))
    rows = rows.withColumn("_p", place).withColumn("_q", F.lag(place).over(order))
    length = F.length(C.strip(F.coalesce("text", F.lit(""))))
    rules = {
        "duplicate_id": F.col("_n") > 1,
        "empty_text": length == 0,
        "short_fragment": (length > 0) & (length < short),
        "abnormally_long": F.length("text") > long,
        "malformed_id": ~ok,
        "mixed_chapter": ok & (parts["chapter"] != F.col("chapter")),
        "non_monotonic_id": F.col("_p") < F.col("_q"),
    }
    fired = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return rows.select(F.explode(fired).alias("issue"), "id")


def page_gaps(rows: DataFrame, by: list[str], pages: str = "source_pages") -> DataFrame:
    """(*by, before, after): neighbouring source pages that lie more than one apart."""
    one = rows.select(*by, F.explode(pages).alias("page")).distinct()
    after = F.lead("page").over(W.partitionBy(*by).orderBy("page"))
    return one.select(*by, F.col("page").alias("before"), after.alias("after")).filter("after - before > 1")


def id_impact(old: DataFrame, new: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Each id as kept, changed, added or removed between two versions: (id, impact)."""
    a = old.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("_a"))
    b = new.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("_b"))
    impact = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "kept").otherwise("changed")
    return a.join(b, "id", "full").select("id", impact.alias("impact"))


def common_prefix(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(*by, prefix): length of the common prefix of two ordered id lists (*by, pos, id)."""
    x = a.select(*by, "pos", F.col("id").alias("_a"))
    y = b.select(*by, "pos", F.col("id").alias("_b"))
    joined = x.join(y, [*by, "pos"], "full")
    first = F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("pos")))
    return joined.groupBy(*by).agg(F.coalesce(first - 1, F.count(F.lit(1))).cast("int").alias("prefix"))


def ordered_digests(rows: DataFrame, by: list[str], order: str = "pos", value: str = "id") -> DataFrame:
    """(*by, digest): digest of the values of a group in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return rows.groupBy(*by).agg(C.ordered_digest(items).alias("digest"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def similarity(df: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """Add the matching-block ratio of two texts; null counts as empty."""
    return df.withColumn(out, _ratio(F.col(a), F.col(b)))


def stream_form(text):
    """Text without white space and punctuation, for comparing streams."""
    return F.regexp_replace(C.col(text), r"(?U)[\s\p{P}]+", "")


def chapter_differences(chapters: DataFrame, least: int = 20) -> DataFrame:
    """(key, op, old_text, new_text) of regions of at least ``least`` characters that differ between two streams of a chapter."""
    schema = "key string, op string, old_text string, new_text string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        out = []
        for r in pdf.itertuples():
            a, b = r.old or "", r.new or ""
            for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                if op != "equal" and max(j - i, m - k) >= least:
                    out.append((r.key, op, a[i:j], b[k:m]))
        return pd.DataFrame(out, columns=["key", "op", "old_text", "new_text"])

    return chapters.select("key", "old", "new").groupBy("key").applyInPandas(run, schema)


def best_local_ratio(haystack: str, needle: str, window: int = 300) -> float:
    """Best ratio of the beginning of ``needle`` against windows of ``haystack`` that overlap by two thirds; stops above 0.95."""
    return matching.best_window(haystack, needle[:window], window, max(1, window // 3), 0.95)


def chapter_regions(chapters: DataFrame, least: int = 20) -> DataFrame:
    """Regions of at least ``least`` characters that the new stream has and the old one lacks, from (key, old, raw, new).

    Each region is looked for in the old stream and in the raw text that was cleaned into it: (key, op, at, new_text,
    ratio_old, ratio_raw, verdict). Chapters stay in the partitions they come in; null streams count as empty.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                old, raw, new = r.old or "", r.raw or "", r.new or ""
                known: dict[str, tuple[float, float]] = {}  # regions recur within a chapter, as running titles do
                for op, _, _, k, m in matching.differences(old, new):
                    if op in ("insert", "replace") and m - k >= least:
                        text = new[k:m]
                        if text not in known:
                            known[text] = best_local_ratio(old, text), best_local_ratio(raw, text)
                        clean, scan = known[text]
                        verdict = "in_clean" if clean >= 0.8 else "dropped_in_cleaning" if scan >= 0.8 else "degraded_in_raw" if scan >= 0.55 else "absent"
                        out.append((r.key, op, k, text, clean, scan, verdict))
            yield pd.DataFrame(out, columns=["key", "op", "at", "new_text", "ratio_old", "ratio_raw", "verdict"])

    schema = "key string, op string, at int, new_text string, ratio_old double, ratio_raw double, verdict string"
    return chapters.select("key", "old", "raw", "new").mapInPandas(run, schema)


def runs_of_rows(dark: DataFrame, by: list[str], least: int = 8) -> DataFrame:
    """(*by, first, last): runs of consecutive rows, of at least ``least`` rows: islands in a set of row numbers."""
    island = F.col("row") - F.row_number().over(W.partitionBy(*by).orderBy("row"))
    return dark.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter(F.col("last") - F.col("first") + 1 >= least).drop("_i")


def containing_paragraph(offsets: DataFrame, paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, offset, paragraph): the paragraph in whose stretch of the joined stream an offset lies: an as-of join.

    Starts and offsets are merged in one ordered window, so no offset is compared with all starts.
    """
    start = F.coalesce(F.sum(F.length("text")).over(W.partitionBy(*by).orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = paragraphs.select(*by, start.alias("at"), F.lit(0).alias("kind"), "paragraph")
    asked = offsets.select(*by, F.col("offset").cast("bigint").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("paragraph"))
    w = W.partitionBy(*by).orderBy("at", "kind", "paragraph").rowsBetween(W.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("paragraph", F.last("paragraph", ignorenulls=True).over(w))
    return found.filter("kind = 1").select(*by, F.col("at").alias("offset"), "paragraph")
