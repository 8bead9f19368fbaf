"""Sentence alignment of rough translations in geometric bitext space.

The two texts of a chapter span a plane; words that translate each other are its points. Translations are learned from
the chapters that are aligned already. Points of two sentences that correspond one to one make a cell. From the end of
the chain found so far a rectangle is enlarged until it holds a chain of cells that runs along the slope of the plane
with little dispersal; cells with stronger rivals in their row or column, and cells that bend off the slope, are noise
and take no part. What the main chain leaves unexplained is searched for chains of its own, the inversions. Chains then
become blocks: a block grows to a sentence whose words nothing else explains, near the line of its chain first.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .looks import form_of

#: Words associate from this Dice coefficient on.
MIN_DICE = 0.12
#: Cells of a chain share more than NOISE of the mean weight of both sentences and CONTAINED of the lighter one. By as much as a
#: rival in their row or column shares more, they count RIVAL of it less, as the rival may be a copy.
NOISE, CONTAINED, RIVAL = 0.2, 0.4, 0.5
#: What a chain must be worth: the sum of what its cells count above NOISE, less what it bends. Inversions have no corner to
#: start from, so each of their cells must share ALONE, and SURE of the lighter sentence.
WORTH, ALONE, SURE = 0.25, 0.35, 0.5
#: A link between two cells may leave the slope by SLACK sentences and this part of its length; a chain by DISPERSAL sentences
#: (root mean square), or that part of the rectangle.
SLACK, ANGLE, DISPERSAL = 2.0, 0.35, 1.5
#: First side of the rectangle in sentences, and its growth.
SIDE, GROWTH = 4.0, 1.5
#: Blocks grow by a sentence when this share of what is unexplained on either side corresponds: within NEAR sentences of the
#: chain, or away from it. At least REST of the sentence and three words must be left unexplained.
PART, FAR_PART, REST, NEAR = 0.6, 0.72, 0.25, 2.5

_WORD = r"[\p{L}\p{M}\p{N}]+(?:[.,][0-9]+)?"
#: The commonest endings, without which inflected forms share their statistics.
ENDINGS = {"de": "(?:en|er|em|es|e|n|s)$", "en": "(?:es|s)$"}


def stems_of(form, lang):
    """Words of a text in its consistent form, lower case, without endings: an array column made in the JVM."""
    bare = lambda w: F.when(F.length(w) > 4, F.when(lang == "de", F.regexp_replace(F.lower(w), ENDINGS["de"], "")).when(lang == "en", F.regexp_replace(F.lower(w), ENDINGS["en"], "")).otherwise(F.lower(w))).otherwise(F.lower(w))
    return F.transform(F.regexp_extract_all(form, F.lit(_WORD), F.lit(0)), bare)


def segment_words(segments: DataFrame, langs: tuple[str, str] = ("de", "en")) -> DataFrame:
    """(id, book, lang, chapter, loaded_at, text, words) of the segments of both languages whose text is not blank, written once."""
    part = lambda p: F.regexp_extract("id", p, 1)
    rows = segments.filter(F.length(F.trim("text")) > 0).select(
        "id", part(r"^(.+)_[a-z]+_ch\d+_").alias("book"), part(r"^.+_([a-z]+)_ch\d+_").alias("lang"), F.expr("try_cast(regexp_extract(id, '_ch([0-9]+)_p', 1) AS int)").alias("chapter"), "loaded_at", "text"
    )
    return materialize(rows.filter(F.col("lang").isin(*langs)).withColumn("words", stems_of(form_of("text"), F.col("lang"))), "p1-words")


def record_words(words: DataFrame, alignments: DataFrame, langs: tuple[str, str]) -> DataFrame:
    """(s, t): the distinct stems of both sides of every distinct alignment record of the pair.

    Wrong records are noise that the counts outweigh. Null ids, ids of no segment and null texts are left out; of a
    segment delivered with several texts all count.
    """
    src, tgt = langs
    named = lambda c, lang: F.exists(c, lambda x: x.contains(f"_{lang}_ch"))
    records = alignments.filter((F.col("src_lang") == src) & (F.col("tgt_lang") == tgt) | named("src", src) & named("tgt", tgt)).select("src", "tgt").distinct()
    records = records.withColumn("rec", F.unhex(F.sha2(F.to_json(F.struct("src", "tgt")), 256)))
    sides = records.select("rec", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("src").alias("ids")), F.struct(F.lit("t").alias("side"), F.col("tgt").alias("ids")))).alias("x"))
    told = sides.select("rec", "x.side", F.explode("x.ids").alias("id")).join(words.select("id", "words").distinct(), "id")
    gather = lambda side: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("side") == side, F.col("words")))))
    return materialize(told.groupBy("rec").agg(gather("s").alias("s"), gather("t").alias("t")).select("s", "t"), "p1-records")


def learn_lexicon(records: DataFrame, src_stems: DataFrame, tgt_stems: DataFrame, anchors: DataFrame | None = None, langs: tuple[str, str] = ("de", "en")) -> DataFrame:
    """(src, tgt, strength) of words that translate each other, by the Dice coefficient over all records.

    ``src_stems`` (src) and ``tgt_stems`` (tgt) are the distinct stems that the lexicon is for; words meet by joins with
    them before they are paired, so no word is cut for being rare. Pairs of anchors have strength 1.
    """
    # the stems of a record that are asked for, gathered again, so that pairs are made within one row
    def narrowed(side: str, name: str, stems: DataFrame) -> DataFrame:
        return records.select(F.explode(side).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n_" + name)).join(stems, name, "left_semi")

    n_s, n_t = narrowed("s", "src", src_stems), narrowed("t", "tgt", tgt_stems)
    both = records.select(F.explode("s").alias("src"), "t").select("src", F.explode("t").alias("tgt")).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dice = 2 * F.col("n") / (F.col("n_src") + F.col("n_tgt"))
    best = F.col("n") / F.least("n_src", "n_tgt")
    found = both.join(n_s, "src").join(n_t, "tgt").filter((dice >= MIN_DICE) & ((F.col("n") >= 3) | (best == 1)))
    found = found.select("src", "tgt", F.least(F.lit(1.0), F.greatest(dice, best * F.least(F.lit(1.0), 2 * dice))).alias("strength"))
    if anchors is None:
        return found
    form = lambda i: stems_of(form_of(f"{langs[i]}_form"), F.lit(langs[i]))
    given = anchors.select(F.try_element_at(form(0), F.lit(-1)).alias("src"), F.try_element_at(form(1), F.lit(1)).alias("tgt"), F.lit(1.0).alias("strength")).filter("src IS NOT NULL AND tgt IS NOT NULL")
    return found.unionByName(given).groupBy("src", "tgt").agg(F.max("strength").alias("strength"))


@dataclass
class Lexicon:
    """What is known of the words of one chapter."""

    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    src_weight: dict[str, float] = field(default_factory=dict)
    tgt_weight: dict[str, float] = field(default_factory=dict)
    unknown: float = 1.0  # weight of a stem that no record holds


class Plane:
    """The bitext space of one chapter: sentences are lists of words, none of them empty."""

    def __init__(self, src: list[list[str]], tgt: list[list[str]], lexicon: Lexicon):
        a, b = [w for s in src for w in s], [w for t in tgt for w in t]
        self.s_at, self.t_at = np.cumsum([0, *map(len, src)]), np.cumsum([0, *map(len, tgt)])
        ua, ub = {w: i for i, w in enumerate(dict.fromkeys(a))}, {w: i for i, w in enumerate(dict.fromkeys(b))}
        known = np.zeros((len(ua), len(ub)), np.float32)
        for (v, w), strength in lexicon.pairs.items():
            if v in ua and w in ub:
                known[ua[v], ub[w]] = strength
        for w, i in ua.items():  # names and numbers stay as they are
            if w in ub and (len(w) > 3 or w[0].isdigit()):
                known[i, ub[w]] = 1.0
        self.ws = np.array([lexicon.src_weight.get(w, lexicon.unknown) for w in a], np.float32)
        self.wt = np.array([lexicon.tgt_weight.get(w, lexicon.unknown) for w in b], np.float32)
        #: weight of the point of every two words, 0 where there is none
        self.points = known[[ua[w] for w in a]][:, [ub[w] for w in b]] * np.minimum.outer(self.ws, self.wt)
        self.total_s, self.total_t = np.add.reduceat(self.ws, self.s_at[:-1]), np.add.reduceat(self.wt, self.t_at[:-1])
        self.xs, self.ys = self._middles(src), self._middles(tgt)
        #: length of a sentence on the axes, which both run from 0 to 1, so that the slope is 1
        self.unit = 0.5 / len(src) + 0.5 / len(tgt)

    @staticmethod
    def _middles(texts: list[list[str]]) -> np.ndarray:
        n = np.array([sum(map(len, words)) + len(words) for words in texts], float)
        return (np.cumsum(n) - n / 2) / n.sum()

    def bounds(self) -> np.ndarray:
        """Upper bound of the weight that two sentences can share, for all of them at once."""
        rows = np.add.reduceat(np.maximum.reduceat(self.points, self.t_at[:-1], axis=1), self.s_at[:-1], axis=0)
        cols = np.add.reduceat(np.maximum.reduceat(self.points, self.s_at[:-1], axis=0), self.t_at[:-1], axis=1)
        return np.minimum(rows, cols)

    def match(self, s: int, t: int) -> tuple[float, list[int], list[int]]:
        """Heaviest-first one-to-one correspondence of the words of two sentences: (weight, words, words)."""
        i0, j0 = self.s_at[s], self.t_at[t]
        block = self.points[i0 : self.s_at[s + 1], j0 : self.t_at[t + 1]]
        at = np.argwhere(block > 0)
        order = np.lexsort((at[:, 1], at[:, 0], np.abs(at[:, 0] - at[:, 1]), -block[at[:, 0], at[:, 1]]))
        rows, cols, total = [], [], 0.0
        for i, j in at[order].tolist():
            if i not in rows and j not in cols:
                rows.append(i)
                cols.append(j)
                total += float(block[i, j])
        return total, [int(i0) + i for i in rows], [int(j0) + j for j in cols]

    def explain(self, rows: list[int], cols: list[int]) -> None:
        """Words that a chain or a block explains make no points any more."""
        self.points[rows, :] = 0
        self.points[:, cols] = 0
        self.ws[rows] = 0
        self.wt[cols] = 0

    def bend(self, dx: float, dy: float) -> float:
        """How far a link leaves the slope, 1 being the most that is allowed."""
        return abs(dx - dy) / (SLACK * self.unit + ANGLE * max(dx, dy))


Cell = tuple[int, int]


def cells_of(plane: Plane) -> dict[Cell, tuple[float, float, float]]:
    """Cells that are not noise: (what they count, share of the lighter sentence, share of the mean weight of both)."""
    mean, least = np.add.outer(plane.total_s, plane.total_t) / 2, np.minimum.outer(plane.total_s, plane.total_t)
    out = {}
    for s, t in np.argwhere(plane.bounds() >= np.maximum(NOISE * mean, CONTAINED * least)).tolist():
        weight = plane.match(s, t)[0]
        if weight > NOISE * mean[s, t] and weight >= CONTAINED * least[s, t]:
            out[s, t] = float(weight / mean[s, t]), float(weight / least[s, t])
    row: dict[int, float] = {}
    col: dict[int, float] = {}
    for (s, t), (share, _) in out.items():
        row[s], col[t] = max(share, row.get(s, 0)), max(share, col.get(t, 0))
    counted = {c: (share - NOISE - RIVAL * (max(row[c[0]], col[c[1]]) - share), lighter, share) for c, (share, lighter) in out.items()}
    return {c: v for c, v in counted.items() if v[0] > 0}


def best_chain(plane: Plane, cells: dict[Cell, tuple[float, float, float]], corner: tuple[float, float] | None) -> tuple[float, list[Cell]]:
    """The chain of greatest worth of the given cells: ascending in both texts, each link along the slope, little dispersal.

    With a corner, the first cell is linked to it. Cells that disperse the chain are taken out, the worst first.
    """
    order = sorted(cells)
    worth: list[float] = []
    before: list[int | None] = []
    for k, c in enumerate(order):
        x, y = plane.xs[c[0]], plane.ys[c[1]]
        start = plane.bend(x - corner[0], y - corner[1]) if corner else 0.0
        best, link = (-0.1 * start if start <= 1 else -np.inf), None
        for m in range(k):
            p = order[m]
            if p[0] < c[0] and p[1] < c[1] and worth[m] > best:
                b = plane.bend(x - plane.xs[p[0]], y - plane.ys[p[1]])
                if b <= 1 and worth[m] - 0.1 * b > best:
                    best, link = worth[m] - 0.1 * b, m
        worth.append(best + cells[c][0])
        before.append(link)
    if not order or max(worth) == -np.inf:
        return 0.0, []
    k = int(np.argmax(worth))
    value, chain = worth[k], []
    while k is not None:
        chain.append(order[k])
        k = before[k]
    chain.reverse()
    while len(chain) > 2:
        off = np.array([plane.ys[t] - plane.xs[s] for s, t in chain])
        off = np.abs(off - np.median(off))
        reach = max(DISPERSAL * plane.unit, ANGLE / 2 * (plane.xs[chain[-1][0]] - plane.xs[chain[0][0]]))
        if float(np.sqrt(np.mean(off**2))) <= reach:
            break
        value -= cells[chain.pop(int(np.argmax(off)))][0]
    return value, chain


def chains(plane: Plane) -> tuple[list[Cell], list[Cell], dict[Cell, float]]:
    """(cells of the main chain, cells of inversions, share of weight by cell); other cells are noise."""
    cells = cells_of(plane)
    main: list[Cell] = []
    x0 = y0 = 0.0
    ahead = cells
    while ahead:
        side, value, chain = SIDE * plane.unit, 0.0, []
        while side < GROWTH:  # the rectangle grows until it holds a chain, or all that is left
            inside = {c: v for c, v in ahead.items() if plane.xs[c[0]] <= x0 + side and plane.ys[c[1]] <= y0 + side}
            value, chain = best_chain(plane, inside, (x0, y0)) if inside else (0.0, [])
            if value >= WORTH and (len(chain) > 1 or side > 2 * SIDE * plane.unit):
                break
            side *= GROWTH
        if value < WORTH:
            break
        # the last cell of a chain that another could follow is judged again from the corner before it
        kept = chain if len(chain) == 1 or len(inside) == len(ahead) else chain[:-1]
        main += kept
        s0, t0 = kept[-1]
        x0, y0 = plane.xs[s0], plane.ys[t0]
        ahead = {c: v for c, v in ahead.items() if c[0] > s0 and c[1] > t0}
    rows, cols = {s for s, _ in main}, {t for _, t in main}
    left = {c: v for c, v in cells.items() if c[0] not in rows and c[1] not in cols and v[2] >= ALONE and v[1] >= SURE}
    moved: list[Cell] = []
    while left:
        value, chain = best_chain(plane, left, None)
        if not chain:
            break
        moved += chain
        rows, cols = {s for s, _ in chain}, {t for _, t in chain}
        left = {c: v for c, v in left.items() if c[0] not in rows and c[1] not in cols}
    return main, moved, {c: v[2] for c, v in cells.items()}


def grow_blocks(plane: Plane, main: list[Cell], taken: list[Cell]) -> list[tuple[int, int, float]]:
    """Parts of joined and divided sentences: what is left of one explained by what is left of another.

    The best part is taken first; after that only the cells of its row and column are judged anew.
    """
    line_x, line_y = [0.0, *(plane.xs[s] for s, _ in main), 1.0], [0.0, *(plane.ys[t] for _, t in main), 1.0]
    partners_s: dict[int, set[int]] = {}
    partners_t: dict[int, set[int]] = {}
    for s, t in taken:
        partners_s.setdefault(s, set()).add(t)
        partners_t.setdefault(t, set()).add(s)
    done = set(taken)
    rest_s, rest_t = np.add.reduceat(plane.ws, plane.s_at[:-1]), np.add.reduceat(plane.wt, plane.t_at[:-1])

    def judge(s: int, t: int):
        if (s, t) in done or rest_s[s] < REST * plane.total_s[s] or rest_t[t] < REST * plane.total_t[t]:
            return None  # nothing of weight is left to explain
        if s not in partners_s and t not in partners_t:
            return None  # a block grows from a chain
        weight, rows, cols = plane.match(s, t)
        share = weight / min(rest_s[s], rest_t[t])
        off = abs(plane.ys[t] - float(np.interp(plane.xs[s], line_x, line_y)))
        near = off <= NEAR * plane.unit or any(abs(x - s) <= 2 for x in partners_t.get(t, ())) or any(abs(x - t) <= 2 for x in partners_s.get(s, ()))
        if len(rows) < 3 or share < (PART if near else FAR_PART):
            return None
        return share - 0.5 * off + 0.1 * near, rows, cols, float(share)

    bound = plane.bounds()
    open_cells = np.argwhere(bound >= REST * np.minimum.outer(plane.total_s, plane.total_t)).tolist()
    version = {(s, t): 0 for s, t in open_cells}
    heap = [(-j[0], s, t, 0, j[1:]) for s, t in open_cells if (j := judge(s, t))]
    heapq.heapify(heap)
    out = []
    while heap:
        _, s, t, seen, (rows, cols, share) = heapq.heappop(heap)
        if version[s, t] != seen:
            continue
        plane.explain(rows, cols)
        rest_s[s] = plane.ws[plane.s_at[s] : plane.s_at[s + 1]].sum()
        rest_t[t] = plane.wt[plane.t_at[t] : plane.t_at[t + 1]].sum()
        done.add((s, t))
        partners_s.setdefault(s, set()).add(t)
        partners_t.setdefault(t, set()).add(s)
        out.append((s, t, share))
        for c in version:
            if c[0] == s or c[1] == t:
                version[c] += 1
                if j := judge(*c):
                    heapq.heappush(heap, (-j[0], *c, version[c], j[1:]))
    return out


def align_chapter(src: list[list[str]], tgt: list[list[str]], lexicon: Lexicon) -> list[tuple[int, int, float, str]]:
    """Pairs of sentences (source, target, confidence, chain) of one chapter, its words given in order."""
    at_s, at_t = [i for i, x in enumerate(src) if len(x)], [i for i, x in enumerate(tgt) if len(x)]
    if not at_s or not at_t:
        return []
    plane = Plane([src[i] for i in at_s], [tgt[i] for i in at_t], lexicon)
    main, moved, share = chains(plane)
    out = [(*c, share[c], "main") for c in main] + [(*c, share[c], "inversion") for c in moved]
    for c in [*main, *moved]:
        plane.explain(*plane.match(*c)[1:])
    out += [(s, t, x, "part") for s, t, x in grow_blocks(plane, main, [*main, *moved])]
    return sorted((at_s[s], at_t[t], x, kind) for s, t, x, kind in out)


def open_chapters(segments: DataFrame, alignments: DataFrame, langs: tuple[str, str] = ("de", "en")) -> DataFrame:
    """(book, chapter) with segments in both languages of which no alignment record names a segment in either."""
    parts = lambda c, i: F.regexp_extract(c, r"^(.+)_([a-z]+)_ch(\d+)_p\d+_s\d+$", i)
    key = lambda c: (parts(c, 1).alias("book"), F.expr(f"try_cast(regexp_extract({c}, '_ch([0-9]+)_p', 1) AS int)").alias("chapter"))
    have = segments.select(*key("id"), parts("id", 2).alias("lang")).filter(F.col("lang").isin(*langs)).groupBy("book", "chapter").agg(F.count_distinct("lang").alias("n")).filter("n = 2").drop("n")
    named = alignments.select(F.explode(F.concat(F.coalesce("src", F.array().cast("array<string>")), F.coalesce("tgt", F.array().cast("array<string>")))).alias("sid"))
    named = named.filter(parts("sid", 2).isin(*langs)).select(*key("sid")).distinct()
    return have.join(named, ["book", "chapter"], "left_anti")


def align_open_chapters(segments: DataFrame, alignments: DataFrame, anchors: DataFrame | None = None, langs: tuple[str, str] = ("de", "en")) -> DataFrame:
    """Alignment records of the open chapters: (book, chapter, src_id, tgt_id, confidence, chain).

    Segments of null, empty or blank text take no part; a segment delivered repeatedly counts once, with its first
    text in order of loading; deleted segments count, as their text may still be rendered. A chapter is one task: it
    keeps its size as the corpus grows. Its part of the lexicon is joined to it, so nothing is collected or broadcast
    and no word is left out. Other columns, whatever their names, are not read.
    """
    words = segment_words(segments, langs)
    records = record_words(words, alignments, langs)
    chosen = words.join(open_chapters(segments, alignments, langs), ["book", "chapter"], "left_semi")
    rows = chosen.groupBy("book", "chapter", "lang", "id").agg(F.min(F.struct("loaded_at", "text", "words")).alias("x")).select("book", "chapter", "lang", "id", F.col("x.words").alias("words"))
    rows = materialize(rows, "p1-open")
    stems = rows.select("book", "chapter", "lang", F.explode("words").alias("stem")).distinct()
    total = F.lit(records.count())
    side = lambda i, name: stems.filter(F.col("lang") == langs[i]).select("book", "chapter", F.col("stem").alias(name))
    src, tgt = side(0, "src"), side(1, "tgt")
    lexicon = materialize(learn_lexicon(records, src.select("src").distinct(), tgt.select("tgt").distinct(), anchors, langs), "p1-lexicon")

    def weights(column: str, name: str, wanted: DataFrame) -> DataFrame:
        counts = records.select(F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        return wanted.join(counts, name, "left").select("book", "chapter", *[F.col(name) if name == x else F.lit(None).cast("string").alias(x) for x in ("src", "tgt")], F.log1p(total / F.coalesce("n", F.lit(1))).alias("value"))

    pairs = src.join(lexicon, "src").join(tgt, ["book", "chapter", "tgt"]).select("book", "chapter", "src", "tgt", F.col("strength").alias("value"))
    known = pairs.unionByName(weights("s", "src", src)).unionByName(weights("t", "tgt", tgt))

    def run(key, texts: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        a, b = (texts[texts.lang == x].sort_values("id", ignore_index=True) for x in langs)
        lex = Lexicon()
        for s, t, v in zip(facts.src, facts.tgt, facts.value):
            if t is None:
                lex.src_weight[s] = v
            elif s is None:
                lex.tgt_weight[t] = v
            else:
                lex.pairs[s, t] = v
        found = align_chapter([list(x) for x in a.words], [list(x) for x in b.words], lex)
        return pd.DataFrame([(key[0], key[1], a.id[s], b.id[t], c, k) for s, t, c, k in found], columns=["book", "chapter", "src_id", "tgt_id", "confidence", "chain"])

    group = ["book", "chapter"]
    facts = spread(known.withColumnsRenamed({k: f"of_{k}" for k in group}), *[f"of_{k}" for k in group]).groupBy(*[f"of_{k}" for k in group])
    return spread(rows, *group).groupBy(*group).cogroup(facts).applyInPandas(run, "book string, chapter int, src_id string, tgt_id string, confidence double, chain string")


def alignment_records(pairs: DataFrame, langs: tuple[str, str] = ("de", "en")) -> DataFrame:
    """Pairs as records: one per connected block of a chapter, with src and tgt arrays, type and confidence.

    A block is what shares a sentence: sentences of a chapter are linked in the chapter's own group, of bounded size.
    """

    def blocks(key, pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in zip(pdf.src_id, pdf.tgt_id):
            root[find(b)] = find(a)
        rows = []
        for _, g in pdf.groupby(pdf.src_id.map(find), sort=True):
            s, t = sorted(set(g.src_id)), sorted(set(g.tgt_id))
            rows.append((key[0], key[1], s, t, *langs, f"{len(s)}:{len(t)}", float(min(1.0, g.confidence.mean()))))
        return pd.DataFrame(rows, columns=["book", "chapter", "src", "tgt", "src_lang", "tgt_lang", "type", "confidence"])

    return pairs.groupBy("book", "chapter").applyInPandas(blocks, "book string, chapter int, src array<string>, tgt array<string>, src_lang string, tgt_lang string, type string, confidence double")
