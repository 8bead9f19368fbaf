"""Alignment of sentence vectors: ratio margins and bonuses as DataFrames, banded dynamic programming per scope."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .skew import sums_before

FLOOR = 0.3


@dataclass(frozen=True)
class AlignSettings:
    """Parameters of the dynamic program; the defaults are those of a bare call."""

    band: float = 0.15
    gap: float = 0.1
    multi: float = 0.02
    max_group: int = 3
    mode: str = "cosine"
    neighbours: int = 4
    length_penalty: float = 0.0
    length_mu: float = 3.45
    length_tau: float = 1.1
    wall_margin: float = 0.15
    two_pass: bool = False
    review_below: float = 0.5
    anchor_weight: float = 0.3
    anchor_cap: float = 0.15


#: The settings of full runs.
PRODUCTION = AlignSettings(gap=0.18, multi=0.01, max_group=5, mode="ratio", length_penalty=0.05, two_pass=True)


class Encoder(Protocol):
    """Turns texts into unit vectors; a model is loaded once per Python worker."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEncoder:
    """A deterministic encoder without a model: signed hashes of character trigrams."""

    dimensions: int = 64
    name: str = "hash-trigrams"

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimensions))
        for r, t in enumerate(texts):
            padded = f"  {t.lower()} "
            for i in range(len(padded) - 2):
                h = zlib.crc32(padded[i : i + 3].encode())
                out[r, h % self.dimensions] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, encoder: Encoder, text: str = "text", out: str = "vector") -> DataFrame:
    """Add ``out`` array<double>; null text is encoded like empty text."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode([t or "" for t in texts])))

    return df.withColumn(out, run(F.col(text)))


def cache_key(df: DataFrame, encoder: str, schema: str = "3") -> DataFrame:
    """Add ``digest`` of schema, encoder, language, scope, ids and texts of a scope in order: the key of cached vectors."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))), lambda x: F.concat(x["id"], F.lit("\x1e"), F.coalesce(x["text"], F.lit("")), F.lit("\x1f")))
    per = df.groupBy("lang", "scope").agg(F.concat_ws("", items).alias("_all"))
    return per.select("lang", "scope", F.sha2(F.concat_ws("\x1f", F.lit(schema), F.lit(encoder), "lang", "scope", "_all"), 256).alias("digest"))


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Scopes whose digest is not cached."""
    return wanted.join(cached.select("digest").distinct(), "digest", "left_anti")


def ratio(sims: np.ndarray, k: int) -> np.ndarray:
    """Similarities against the mean of the best of row and column, squashed."""
    k = max(1, min(k, *sims.shape))
    best = lambda axis: np.sort(sims, axis=axis).take(range(-k, 0), axis=axis).mean(axis=axis, keepdims=True)
    r = sims / np.maximum((best(1) + best(0)) / 2, 1e-9)
    return r / (1 + r)


class Program:
    """One run of the dynamic program over a similarity matrix."""

    def __init__(self, sims: np.ndarray, s: AlignSettings, lengths: tuple | None, single: bool):
        self.s, self.single = s, single
        self.n, self.m = sims.shape
        self.sums = np.zeros((self.n + 1, self.m + 1))
        self.sums[1:, 1:] = sims.cumsum(0).cumsum(1)
        self.has_lengths = lengths is not None
        src, tgt = lengths if lengths is not None else (np.full(self.n, np.inf), np.full(self.m, np.inf))
        self.chars = [np.concatenate([[0], np.cumsum(x)]) for x in (src, tgt)] if self.has_lengths else None
        self.extra = [np.concatenate([[0], np.cumsum(np.minimum(1.0, np.asarray(x) / 60))]) for x in (src, tgt)]
        size = 1 if single else s.max_group
        self.moves = [(a, b) for a in range(1, size + 1) for b in range(1, size + 1) if a + b <= (2 if single else size + 1)]
        self.best = np.full((self.n + 1, self.m + 1), -np.inf)
        self.back = np.full((self.n + 1, self.m + 1), -1, int)
        self.run()

    def paired(self, i: int, js: np.ndarray, a: int, b: int) -> np.ndarray:
        """Score of the move (a, b) into cells (i, js); minus infinity below the floor."""
        p, q = i - a, js - b
        mean = (self.sums[i, js] - self.sums[p, js] - self.sums[i, q] + self.sums[p, q]) / (a * b)
        cost = self.extra[0][i] - self.extra[0][p + 1] + self.extra[1][js] - self.extra[1][q + 1]
        score = mean - self.s.multi * cost
        if self.s.length_penalty > 0 and self.has_lengths:
            x, y = self.chars[0][i] - self.chars[0][p], self.chars[1][js] - self.chars[1][q]
            with np.errstate(divide="ignore", invalid="ignore"):
                off = np.abs(np.log(x / y / self.s.length_mu)) - self.s.length_tau
            score = score - np.where((x > 0) & (y > 0), self.s.length_penalty * np.maximum(0, off), 0.0)
        return np.where(mean < FLOOR, -np.inf, score)

    def window(self, i: int) -> np.ndarray:
        centre, reach = int(round(i * self.m / self.n)), int(max(1, self.s.band * self.m))
        return np.arange(max(0, centre - reach), min(self.m + 1, centre + reach + 1))

    def totals(self, i: int, js: np.ndarray) -> np.ndarray:
        """Totals of all moves but (0, 1) into cells (i, js), one row per move in order of preference."""
        rows = [self.best[i - 1, js] - self.s.gap if i else np.full(len(js), -np.inf)]
        for a, b in self.moves:
            row = np.full(len(js), -np.inf)
            if i >= a:
                ok = js >= b
                row[ok] = self.best[i - a, js[ok] - b] + self.paired(i, js[ok], a, b)
            rows.append(row)
        return np.array(rows)

    def run(self) -> None:
        """Fill row by row: moves from earlier rows at once, then the moves along the row. Of equal totals the first move wins."""
        self.best[0, 0] = 0.0
        for i in range(self.n + 1):
            js = self.window(i)
            totals = self.totals(i, js)
            choice = totals.argmax(0)
            for x, j in enumerate(js):
                if i == 0 and j == 0:
                    continue
                total, move = totals[choice[x], x], choice[x]
                along = self.best[i, j - 1] - self.s.gap if j else -np.inf
                if along > total or along == total and move != 0 and along > -np.inf:
                    total, move = along, len(self.moves) + 1
                if total > -np.inf:
                    self.best[i, j], self.back[i, j] = total, move

    def records(self) -> list[tuple[list[int], list[int], float, float | None]]:
        """(source, target, score, margin) in order; the margin is the lead over the best other move into the cell."""
        i, j, out = self.n, self.m, []
        steps = [(1, 0), *self.moves, (0, 1)]
        while (i or j) and self.back[i, j] >= 0:
            move = self.back[i, j]
            a, b = steps[move]
            rivals = list(self.totals(i, np.array([j]))[:, 0]) + [self.best[i, j - 1] - self.s.gap if j else -np.inf]
            rivals = [x for k, x in enumerate(rivals) if k != move and x > -np.inf]
            score = -self.s.gap if 0 in (a, b) else float(self.paired(i, np.array([j]), a, b)[0])
            out.append((list(range(i - a, i)), list(range(j - b, j)), max(0.0, score), float(self.best[i, j] - max(rivals)) if rivals else None))
            i, j = i - a, j - b
        return out[::-1]


def align_vectors(src: np.ndarray, tgt: np.ndarray, settings: AlignSettings = AlignSettings(), lengths: tuple | None = None, bonus: np.ndarray | None = None, single: bool = False):
    """Records of two sequences of unit vectors; nothing for an empty side."""
    if settings.mode not in ("cosine", "ratio"):
        raise ValueError(f"unknown similarity mode {settings.mode!r}")
    if not len(src) or not len(tgt):
        return []
    sims = np.asarray(src, float) @ np.asarray(tgt, float).T
    if settings.mode == "ratio":
        sims = ratio(sims, settings.neighbours)
    return Program(sims if bonus is None else sims + bonus, settings, lengths, single).records()


def align_two_pass(src: np.ndarray, tgt: np.ndarray, settings: AlignSettings, lengths: tuple | None = None, bonus: np.ndarray | None = None):
    """Sure one-to-one records of a first pass are walls; between them the whole program runs on its own."""
    walls = [r for r in align_vectors(src, tgt, settings, lengths, bonus, True) if r[0] and r[1] and r[3] is not None and r[3] >= settings.wall_margin]
    if len(walls) < 2:
        return align_vectors(src, tgt, settings, lengths, bonus)
    out, a, b = [], 0, 0
    for wall in [*walls, None]:
        i, j = (wall[0][0], wall[1][0]) if wall else (len(src), len(tgt))
        if a < i and b < j:
            part = align_vectors(src[a:i], tgt[b:j], settings, None if lengths is None else (lengths[0][a:i], lengths[1][b:j]), None if bonus is None else bonus[a:i, b:j])
            out += [([x + a for x in s], [y + b for y in t], score, margin) for s, t, score, margin in part]
        else:
            out += [([x], [], 0.0, None) for x in range(a, i)] + [([], [y], 0.0, None) for y in range(b, j)]
        if wall:
            out.append(wall)
            a, b = i + 1, j + 1
    return out


def bonus_matrix(src: list[set[str]], tgt: list[set[str]], settings: AlignSettings) -> np.ndarray:
    """The bonus of all pairs of a scope, as ``anchor_bonus`` gives it: anchors weigh by inverse frequency over both sides."""
    n = max(2, len(src) + len(tgt))
    out = np.zeros((len(src), len(tgt)))
    for anchor in sorted(set().union(*src) & set().union(*tgt)):
        rows, cols = ([i for i, x in enumerate(side) if anchor in x] for side in (src, tgt))
        df = len(rows) + len(cols)
        out[np.ix_(rows, cols)] += min(1.0, np.log(n / df) / np.log(n)) if df < n else 0.0
    return np.minimum(settings.anchor_cap, settings.anchor_weight * out)


ALIGNED = "scope string, ord int, src array<string>, tgt array<string>, type string, confidence double, margin double, needs_review boolean"


def align_scopes(src: DataFrame, tgt: DataFrame, settings: AlignSettings = PRODUCTION) -> DataFrame:
    """Alignment records of every scope: ``src`` and ``tgt`` hold (scope, pos, id, text, vector) and may hold anchors.

    A scope, such as a chapter, is one task on each side; scopes run in parallel. A scope with one side only gives no
    records. Gap records have confidence 0 and always need review. Where both sides have anchors, pairs that share some
    get their bonus in each run of the program; null anchors are like none.
    """

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            a, b = (x.set_axis(pick, axis=1).sort_values("pos", ignore_index=True) for x in (a, b))
            lengths = tuple(x.text.fillna("").str.len().to_numpy(float) for x in (a, b))
            go = align_two_pass if settings.two_pass else align_vectors
            bonus = bonus_matrix(*([set() if v is None else set(v) for v in x.anchors] for x in (a, b)), settings) if anchored else None
            for n, (s, t, score, margin) in enumerate(go(np.stack(a.vector), np.stack(b.vector), settings, lengths, bonus)):
                confidence = max(0.0, min(1.0, score))
                rows.append((key[0], n + 1, [a.id[i] for i in s], [b.id[j] for j in t], f"{len(s)}:{len(t)}", confidence, margin, confidence < settings.review_below))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ALIGNED.split(", ")])

    anchored = "anchors" in src.columns and "anchors" in tgt.columns
    pick = ["scope", "pos", "id", "text", "vector", *["anchors"] * anchored]
    # sides of one origin share their attributes, so each gets columns of its own
    left, right = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in pick]).groupBy(f"{side}_scope") for df, side in ((src, "s"), (tgt, "t")))
    return left.cogroup(right).applyInPandas(run, ALIGNED)


def numbered(records: DataFrame) -> DataFrame:
    """Add ``align_id`` a0001... in order of scope and record, from the counts of the scopes before."""
    counts = records.groupBy("scope").agg(F.count(F.lit(1)).alias("_n"))
    before = sums_before(counts, ["scope"], "_n", "_before").drop("_n")
    return records.join(before, "scope").withColumn("align_id", F.format_string("a%04d", (F.col("_before") + F.col("ord")).cast("int"))).drop("_before")


def pair_scores(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(scope, src_id, tgt_id, score): cosines of all pairs of a scope, which bounds them."""
    a = src.select("scope", F.col("id").alias("src_id"), F.col("vector").alias("_a"))
    b = tgt.select("scope", F.col("id").alias("tgt_id"), F.col("vector").alias("_b"))
    return a.join(b, "scope").select("scope", "src_id", "tgt_id", C.dot("_a", "_b").alias("score"))


def ratio_scores(pairs: DataFrame, k: int = 4) -> DataFrame:
    """Add ``ratio``: the score against the means of the ``k`` best of its row and its column."""
    def mean_of_best(by: str, other: str, out: str) -> DataFrame:
        w = W.partitionBy("scope", by).orderBy(F.desc("score"), other)
        top = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return top.groupBy("scope", by).agg(F.avg("score").alias(out))

    joined = pairs.join(mean_of_best("src_id", "tgt_id", "_f"), ["scope", "src_id"]).join(mean_of_best("tgt_id", "src_id", "_b"), ["scope", "tgt_id"])
    return joined.withColumn("ratio", C.squashed_ratio("score", "_f", "_b")).drop("_f", "_b")


def anchor_weights(sentences: DataFrame) -> DataFrame:
    """(scope, anchor, weight): inverse frequency of each anchor over the sentences (scope, id, anchors) of both sides."""
    n = sentences.groupBy("scope").agg(F.count(F.lit(1)).alias("_n"))
    df = sentences.select("scope", F.explode("anchors").alias("anchor")).groupBy("scope", "anchor").agg(F.count(F.lit(1)).alias("_df"))
    return df.join(n, "scope").select("scope", "anchor", C.idf("_n", "_df").alias("weight"))


def anchor_bonus(src: DataFrame, tgt: DataFrame, weight: float = 0.3, cap: float = 0.15) -> DataFrame:
    """(scope, src_id, tgt_id, bonus) of pairs that share an anchor: joined by anchor, not by scanning all pairs."""
    weights = anchor_weights(src.select("scope", "id", "anchors").unionByName(tgt.select("scope", "id", "anchors")))
    side = lambda df, name: df.select("scope", F.col("id").alias(name), F.explode("anchors").alias("anchor"))
    shared = side(src, "src_id").join(side(tgt, "tgt_id"), ["scope", "anchor"]).join(weights, ["scope", "anchor"])
    return shared.groupBy("scope", "src_id", "tgt_id").agg(F.least(F.lit(cap), weight * F.sum("weight")).alias("bonus"))


def summary(alignments: DataFrame, by: list[str]) -> DataFrame:
    """Records, confidence and margin figures per group; null margins and confidences are left out of means."""
    return alignments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.avg("confidence").alias("mean_confidence"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.count_if(F.col("confidence") < 0.5).alias("below_half"), F.avg("margin").alias("mean_margin"), F.count_if(F.col("margin") < 0.02).alias("thin_margin"), F.count_if("needs_review").alias("needs_review"),
    )


def type_counts(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("type", "method").agg(F.count(F.lit(1)).alias("n"))


def sources_twice(alignments: DataFrame) -> DataFrame:
    """Source segments in several records of a language pair: (src_lang, tgt_lang, segment_id, records)."""
    rows = alignments.select("src_lang", "tgt_lang", "align_id", F.explode(F.array_compact("src")).alias("segment_id"))
    return rows.groupBy("src_lang", "tgt_lang", "segment_id").agg(F.count_distinct("align_id").alias("records")).filter("records > 1")


def legacy_record(df: DataFrame) -> DataFrame:
    """Older records in today's form: en/zh sides, the old method name, languages from the ids."""
    lang = lambda ids: F.nullif(F.regexp_extract(F.coalesce(F.get(ids, F.lit(0)), F.lit("")), r"^[a-z0-9]+_([a-z]{2,3})_ch", 1), F.lit(""))
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    strings = "array<string>"
    src, tgt = (F.coalesce(have(a).cast(strings), have(b).cast(strings), F.array().cast(strings)) for a, b in (("src", "en"), ("tgt", "zh")))
    return df.withColumn("src", src).withColumn("tgt", tgt).withColumn("src_lang", F.coalesce(have("src_lang").cast("string"), lang(F.col("src")))).withColumn("tgt_lang", F.coalesce(have("tgt_lang").cast("string"), lang(F.col("tgt")))).withColumn("method", F.when(F.col("method") == "vecalign_labse", "embedding_dp").otherwise(F.col("method")))


def with_settings(**changes) -> AlignSettings:
    return replace(PRODUCTION, **changes)


def positional_agreement(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(*by, compared, agree_rate): how often two confidence sequences (*by, pos, confidence) agree at the same place."""
    joined = a.select(*by, "pos", F.col("confidence").alias("_a")).join(b.select(*by, "pos", F.col("confidence").alias("_b")), [*by, "pos"])
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("compared"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agree_rate"))
