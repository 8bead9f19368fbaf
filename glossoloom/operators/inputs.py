"""What stands before a run: which side of a record is which, what a cache holds, what artifacts refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import align
from .skew import skew_safe_left_join

_ANY_ID = r"[a-z0-9]+_[a-z]+_ch[0-9]{2}_p[0-9]{4}_s[0-9]{3}"


def side_languages(records: DataFrame, expected: Column, first: str = "src", second: str = "tgt") -> DataFrame:
    """Add ``{first}_side``, ``{second}_side`` and ``fault`` to alignment records.

    The language of a side is that of its ids. A side without ids has the one expected language that the other side
    has not, if there is just one. Faults, the first that holds: ``unparseable`` id, ``mixed`` languages, ``unexpected``
    language, ``repeated`` id on both sides; a side that repeats the other as a whole is no side. Null sides are empty.
    """
    ids = {k: F.coalesce(k, F.array().cast("array<string>")) for k in (first, second)}
    lang = lambda x: F.nullif(F.regexp_extract(x, r"^[a-z0-9]+_([a-z]+)_ch\d{2}_p\d{4}_s\d{3}$", 1), F.lit(""))
    langs = {k: F.array_distinct(F.transform(v, lambda x: F.coalesce(lang(x), F.lit("?")))) for k, v in ids.items()}
    same = (ids[first] == ids[second]) & (F.size(ids[first]) > 0)
    either = lambda test: test(first) | test(second)
    fault = (
        F.when(either(lambda k: F.array_contains(langs[k], "?")), "unparseable")
        .when(either(lambda k: F.size(langs[k]) > 1), "mixed")
        .when((F.size(expected) > 0) & (F.size(F.array_except(F.array_union(langs[first], langs[second]), expected)) > 0), "unexpected")
        .when(~same & F.arrays_overlap(ids[first], ids[second]), "repeated")
    )
    left = F.array_except(expected, F.array_union(langs[first], langs[second]))
    named = {k: F.when(F.size(langs[k]) == 1, F.get(langs[k], F.lit(0))).when((F.size(langs[k]) == 0) & (F.size(left) == 1), F.get(left, F.lit(0))) for k in ids}
    return records.withColumns({f"{first}_side": F.when(fault.isNull(), named[first]), f"{second}_side": F.when(fault.isNull() & ~same, named[second]), "fault": fault})


def blocks_in_order(alignments: DataFrame, blocks: DataFrame, ids: str = "src") -> DataFrame:
    """(align_id, pos, segment_id, sent_ids): parse blocks of every segment of a side in order, empty where it has none.

    ``blocks`` hold (segment_id, ord, sent_id). Equal records count once.
    """
    index = blocks.filter("segment_id IS NOT NULL").groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "sent_id"))), lambda x: x["sent_id"]).alias("sent_ids"))
    named = alignments.select("align_id", ids).distinct().select("align_id", F.posexplode(ids).alias("pos", "segment_id"))
    return named.join(index, "segment_id", "left").withColumn("sent_ids", F.coalesce("sent_ids", F.array().cast("array<string>")))


def flagged(rows: DataFrame, listed: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add ``out``, Y or N: is the key of a row among those listed? Null keys are not; rows of hot keys stay in place."""
    named = listed.select(*keys).dropna().distinct().withColumn("_in", F.lit(True))
    return skew_safe_left_join(rows, named, keys).withColumn(out, F.when(F.col("_in"), "Y").otherwise("N")).drop("_in")


def shared_ids(rows: DataFrame, key: str, scope: Column) -> DataFrame:
    """(key, scopes): keys that stand in several scopes, which therefore cannot be put together."""
    return rows.groupBy(key).agg(F.count_distinct(scope).alias("scopes")).filter("scopes > 1")


def artifact_references(artifacts: DataFrame, known: DataFrame, name: str = "file_name", text: str = "line") -> DataFrame:
    """(name, mentions, ids, unknown): segment ids that texts of artifacts mention, and how many are no known id (id)."""
    said = artifacts.select(name, F.explode(F.regexp_extract_all(text, F.lit(_ANY_ID), F.lit(0))).alias("id")).groupBy(name, "id").agg(F.count(F.lit(1)).alias("n"))
    met = said.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    return met.groupBy(name).agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("_known").isNull()).alias("unknown"))


def run_configs(scopes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A configuration for every pair of languages and chapter: (book, chapter, src_lang, tgt_lang, src_path, tgt_path, dataset_scope)."""
    listed = F.array(*[F.struct(F.lit(a).alias("src_lang"), F.lit(b).alias("tgt_lang")) for a, b in pairs])
    rows = scopes.select("book", "chapter").distinct().select("book", "chapter", F.explode(listed).alias("p")).select("book", "chapter", "p.*")
    path = lambda lang: F.format_string("segments/%s/%s/ch%02d.jsonl", "book", lang, "chapter")
    return rows.select("*", path("src_lang").alias("src_path"), path("tgt_lang").alias("tgt_path"), F.lit("full").alias("dataset_scope"))


def cache_outcomes(wanted: DataFrame, cached: DataFrame, by: list[str]) -> DataFrame:
    """(*by, outcome) of every wanted scope against cached ones: ``hit``, ``ids_differ``, ``texts_differ`` or ``missing``.

    Both hold (*by, id, text), ids once a scope. A scope is taken as a whole or not at all. Null texts are empty ones.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        digest = lambda *cs: F.sha2(F.concat_ws("\x1f", *cs), 256)
        items = df.select(*by, "id", digest(F.col("id")).alias("i"), digest(F.col("id"), F.coalesce("text", F.lit(""))).alias("t"))
        gathered = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c]), ""), 256)
        return items.groupBy(*by).agg(gathered("i").alias(f"{name}_ids"), gathered("t").alias(f"{name}_texts"))

    met = side(wanted, "w").join(side(cached, "c"), by, "left")
    outcome = F.when(F.col("c_ids").isNull(), "missing").when(F.col("c_ids") != F.col("w_ids"), "ids_differ").when(F.col("c_texts") != F.col("w_texts"), "texts_differ").otherwise("hit")
    return met.select(*by, outcome.alias("outcome"))


def embed_cached(sentences: DataFrame, encoder: align.Encoder, store: str) -> DataFrame:
    """Vectors of (lang, scope, pos, id, text), taken from ``store`` where its digest of a scope agrees and encoded elsewhere.

    What is encoded is appended to the store, so a second run encodes nothing. A store that does not exist is empty;
    ids that are null or repeated in a scope are an error, as their vectors could not be told apart.
    """
    spark = sentences.sparkSession
    bad = sentences.groupBy("lang", "scope", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").head()
    if bad is not None:
        raise ValueError(f"id {bad.id!r} of scope {bad.scope!r} is null or repeated")
    wanted = align.cache_key(sentences, encoder.name)
    columns = "digest string, lang string, scope string, id string, vector array<double>"

    def known() -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(columns).parquet(store) if exists else spark.createDataFrame([], columns)

    missing = align.cache_misses(wanted, known())
    fresh = align.embed(sentences.join(missing, ["lang", "scope"]), encoder)
    fresh.select("digest", "lang", "scope", "id", "vector").write.mode("append").parquet(store)
    return sentences.join(wanted, ["lang", "scope"]).join(known().select("digest", "id", "vector"), ["digest", "id"]).drop("digest")


def first_examples(issues: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The first ``n`` keys of each kind, as a report shows them; each task keeps its own first ones before they meet."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(key))
    return issues.select(by, key).distinct().withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def alignment_manifest(alignments: DataFrame) -> DataFrame:
    """One entry for each pair and chapter: (scope, src_lang, tgt_lang, records, needs_review, mean_confidence, ids_digest, status)."""
    rows = alignments.withColumn("scope", C.scope_of(F.get("src", F.lit(0)))).filter("scope IS NOT NULL")
    out = rows.groupBy("scope", "src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("records"), F.count_if("needs_review").alias("needs_review"), F.avg("confidence").alias("mean_confidence"), F.sha2(F.array_join(F.array_sort(F.collect_set("align_id")), ","), 256).alias("ids_digest"))
    return out.withColumn("status", F.when(F.col("needs_review") > 0.5 * F.col("records"), "needs_review").otherwise("ok"))


def slug(text) -> Column:
    """A name made safe for a path; ``model`` where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(C.col(text), r"[^A-Za-z0-9.-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("model"))


def int_or_minus(text) -> Column:
    """A whole number from text; -1 where it is none."""
    return F.coalesce(C.col(text).try_cast("int"), F.lit(-1))
