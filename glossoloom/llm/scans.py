"""Noise in text from scanned pages: furniture, broken words and misread words, and the text without them.

Running titles are learned from lines and phrases that recur over the pages of a book, page numbers from the constant
distance of printed and physical number. Skip-gram vectors are learned from the cleaned text; rare words are linked
to frequent words that glyph confusions turn into them, and each occurrence is corrected where its context agrees.
Furniture is then removed, broken words are joined, and blocks are reflowed to paragraphs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache, cached_property, lru_cache, reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, spread
from .looks import INVISIBLE, PLAIN, same_look

#: A word has a vector of its own when it makes up more than 1 / MAX_WORDS of its language's words: fewer than MAX_WORDS words.
MAX_WORDS = 1 << 15
#: A linked word can be misread when it is at most this part as frequent as the word it is linked with.
RARITY = 0.1
#: A correction needs CERTAIN: the score of the edit, PRIOR for each power of ten by which the word is rarer than the linked
#: word, less STRANGE times the logarithm of how far the word's contexts are from those of the linked word, in units of what
#: chance explains. Of several words the context at hand decides with weight HERE.
CERTAIN, PRIOR, STRANGE, HERE = 0.7, 0.35, 0.5, 0.05
#: Links that are taken for granted: of an edit as misreading, of an edit as words that are merely alike, and of all edits of a kind.
GRANTED, FEW = (0.5, 1.5), 100
#: Size and window of the skip-gram vectors, and the words that one partition trains on.
DIMENSIONS, WINDOW, TRAINED = 16, 3, 250_000
#: Bits of the filter of linked words, and the words that are handled at once.
BITS, AT_ONCE = 1 << 22, 50_000
#: A line or phrase on so many pages of a book is a running title; one that nothing else tells is taken to have so many words.
TITLE_PAGES, TITLE_WORDS = 2, 3
#: A word counts by numbers when it stands beside one so often and in this part of its occurrences. A capital in the midst of a
#: sentence is foreign to it when the word is small there so often, and capital in at most this part.
COUNTS, COUNTING, SMALL, CAPITAL = 3, 0.2, 10, 0.1

#: Marks that break words at line ends.
HYPHENS = "-‐¬\xad"
#: Words before which a hyphen may stand for the rest of a compound.
LINKED = {"de": ("und", "oder", "bis")}
_TERMINAL = ".!?…。！？:：\"”“’‘«»」』)）"
_LETTER = r"[^\W\d_]"
_PUNCT = re.compile(r"[.!?,;:…。！？，；：、“”„»«「」‘()（）]")
_ROMAN = r"[ivxlcdm]{1,9}"
_CHAPTER = re.compile(r"\s*·\s*(?:[^\W\d_]{3,9}|第)\s*\d+\s*章?\s*$")
_NUMBER_LINE = re.compile(rf"^[\s\x80-\x9f]*(?:[-–—·\[(]\s*)?(?:Seite|Page|第)?\s*(\d{{1,4}}|{_ROMAN})\s*页?(?:\s*[-–—·\])])?[\s\x80-\x9f]*$")
_DECORATED = re.compile(r"[\x80-\x9f]\s*(\d{1,4})\s*[\x80-\x9f]|\[(\d{1,4})\]|[—–-]\s(\d{1,4})\s[—–-]|·\s*(\d{1,4})\s*·|(?<!\w)(?:Seite|Page)\s(\d{1,4})(?=\s|$)|第(\d{1,4})页")
_BARE = re.compile(r"(?<![^ \t\n])[0-9]{1,4}(?![^ \t\n])")
_DIGIT = re.compile(r"\d")
#: Tokens; a line break is one of its own.
_TOKEN = re.compile(r"[^ \t\n]+|\n")
_SPACED = re.compile(r"(?<!\w)(?:[A-ZÄÖÜ]\s+){3,}[A-ZÄÖÜ](?!\w)")
_CAPITALS = re.compile(r"(?<!\w)[A-ZÄÖÜẞ]{2,}(?:\s+[A-ZÄÖÜẞ]{2,})+(?!\w)")
#: A run of Han characters between blanks in the midst of Han text.
_HAN_ISLAND = re.compile(r"(?<=[^\s.!?…。！？”」]) ([㐀-鿿]{3,}) (?=\S)")


@lru_cache(10_000)
def roman(text: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(text, [*text[1:], ""]):
        total += -values[a] if b and values[a] < values[b] else values[a]
    return total


def number(text: str) -> int:
    return int(text) if text.isdigit() else roman(text)


@cache
def _clean_pattern() -> re.Pattern:
    """Invisible characters but the soft hyphen at a line end or text end, which shows as a hyphen."""
    return re.compile("[" + "".join(re.escape(chr(i)) for i in INVISIBLE if i != 0xAD) + "]|\xad(?!\n|$)")


def readable(text: str | None) -> str:
    """The look-alike form of a scanned text, with the marks that break words kept as hyphens."""
    t = _clean_pattern().sub("", text or "")
    t = same_look(t.replace("\xad", "¬")) or ""
    return re.sub(f"[{HYPHENS}]", "-", t) if re.search(f"[{HYPHENS}]", t) else t


def title_key(text: str) -> str:
    """Letters of a title, without case, spaces, numbers and chapter mark."""
    return "".join(re.findall(_LETTER, _CHAPTER.sub("", text))).lower()


def misread(a: str, b: str) -> bool:
    """Do two different keys differ by at most two letters for each ten, or in one stretch of that length?"""
    n = min(len(a), len(b))
    if len(a) == len(b):
        return n >= 6 and sum(x != y for x, y in zip(a, b)) <= max(2, n // 5)
    if abs(len(a) - len(b)) > n // 10 + 1:
        return False
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    return n >= 6 and max(len(a), len(b)) - i - j <= max(2, n // 5)


def title_core(line: str) -> tuple[str, int | None, bool] | None:
    """(title, number printed beside it, has a chapter mark) if the line may be a running title."""
    t = line.strip(" \t　")
    bare = _CHAPTER.sub("", t)
    marked = bare != t
    m = re.match(rf"^(?:(\d{{1,4}}|{_ROMAN})\s{{2,}})?(.*?)(?:\s{{2,}}(\d{{1,4}}|{_ROMAN}))?$", bare)
    core = m.group(2).strip()
    printed = m.group(1) or m.group(3)
    if not core or _PUNCT.search(core) or len(title_key(core)) < 3 or re.search(r"[-\d]", core):
        return None
    if not (core[0].isupper() or "㐀" <= core[0] <= "鿿"):
        return None
    return core, number(printed) if printed else None, marked


def numbers_in(text: str, counted: set[int]) -> list[tuple[int, int, int, bool]]:
    """(start, end, number, decorated) of what may be page numbers: decorated ones, and bare ones that no neighbour counts by."""
    if not _DIGIT.search(text):
        return []
    out = [(m.start(), m.end(), int(next(g for g in m.groups() if g)), True) for m in _DECORATED.finditer(text)]
    bare = [(m.start(), m.end(), int(m.group()), False) for m in _BARE.finditer(text)]
    return out + [x for x in bare if not counted or len(_TOKEN.findall(text, 0, x[0])) not in counted]


def hints(table: str, text: str, pages: list[int], counted: set[int]) -> list[tuple[str, str]]:
    """What one record says about the furniture of its book: ('title', key), ('head', key|form), ('offset', distance)."""
    out = []
    if table == "block":
        lines = [x for x in text.split("\n") if x.strip()]
        for line in {lines[0], lines[-1]} if lines else ():
            core = title_core(line)
            if core and (len(lines) == 1 or len(core[0]) >= 4):
                out.append(("title", title_key(core[0])))
        return out
    if "\n" in text:
        core = title_core(text.split("\n", 1)[0])
        if core:
            out.append(("head", title_key(core[0]) + "|" + core[0]))
    for m in [*_SPACED.finditer(text), *_CAPITALS.finditer(text)]:
        out.append(("head", title_key(m.group()) + "|" + re.sub(r"(?<=\w)\s(?=\w(?:\s|$))", "", m.group())))
    return out + [("offset", str(p - n)) for *_, n, _ in numbers_in(text, counted) for p in pages]


class Book:
    """What is known of a book's furniture in one language."""

    def __init__(self, titles: list[str], heads: list[str], offset: int | None):
        self.titles = set(titles)
        self.heads = dict(h.split("|", 1) for h in sorted(heads))
        self.offset = offset

    def is_title(self, key: str) -> bool:
        """A title of the book, or one misread."""
        return key in self.titles or any(misread(key, t) for t in self.titles)

    @cached_property
    def patterns(self) -> tuple[re.Pattern, ...]:
        """Known titles as they may stand inside other text; all-capital and spaced forms are found without being known."""
        return _title_patterns(tuple(sorted({h for h in self.heads.values() if len(h) >= 4})))


@lru_cache(256)
def _title_patterns(forms: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    """One pattern for titles of several words and one for the others, longer titles first; the chapters of a book share them."""
    longest = sorted(forms, key=lambda f: (-len(f), f))
    several = [r"\s+".join(map(re.escape, f.split())) for f in longest if len(f.split()) > 1]
    single = [re.escape(f) for f in longest if len(f.split()) == 1]
    out = [rf"(?<![\w„“»‘「])(?:{'|'.join(several)})(?!\w)"] if several else []
    return tuple(re.compile(p) for p in [*out, *(["|".join(single)] if single else [])])


class Record:
    """One block or paragraph, as far as it is understood."""

    def __init__(self, row):
        self.row = row
        self.counted, self.foreign = (set() if x is None else set(map(int, x)) for x in (row.counted, row.foreign))
        self.header = self.page_number = self.hyphen = False
        self.body: list[str] = []  # lines without furniture
        self.joined = ""  # text of the record with its own breaks healed
        self.starts_broken = self.ends_broken = False


def scan_chapter(rows: list, table: str, book: Book, compounds: set[str] = frozenset()) -> list[Record]:
    """Find furniture and broken words in the records of one chapter, given in reading order.

    ``compounds`` are hyphenated words of the corpus that are more frequent than their joined form.
    """
    records = [Record(r) for r in rows]
    (_scan_blocks if table == "block" else _scan_paragraphs)(records, book)
    body = [r for r in records if "".join(r.body).strip()]
    for r, after in zip(body, [*body[1:], None]):
        _join(r, after, table, compounds)
    return records


def _scan_blocks(records: list[Record], book: Book) -> None:
    first_page = min((r.row.page for r in records), default=0)
    offsets: Counter[int] = Counter()
    parsed = []
    for r in records:
        lines = r.row.clean.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        found = {}
        for i in {full[0], full[-1]} if full else ():
            core = title_core(lines[i])
            if core and book.is_title(title_key(core[0])):
                found[i] = ("header", core)
                if core[1] is not None:
                    offsets[r.row.page - core[1]] += 1
            elif m := _NUMBER_LINE.match(lines[i]):
                found[i] = ("number", number(m.group(1)), m.group(1).isdigit() and m.group(1) != lines[i].strip())
                offsets[r.row.page - number(m.group(1))] += 1
        parsed.append((r, lines, found))
    offset = max(offsets, key=lambda k: (offsets[k], -abs(k))) if offsets else 0
    title_seen = False
    for r, lines, found in parsed:
        for i, line in enumerate(lines):
            kind = found.get(i)
            if kind and kind[0] == "header":
                core, printed, marked = kind[1]
                opening = not title_seen and r.row.page == first_page and printed is None and not marked and not core.isupper()
                title_seen |= opening
                r.header |= not opening
            elif kind and kind[0] == "number" and (r.row.page - kind[1] == offset or kind[2]):
                r.page_number = True
            elif line.strip() and (len(lines) > 1 or re.search(rf"{_LETTER}.*{_LETTER}", line)):
                r.body.append(line)
        if len(r.body) == 1 and re.fullmatch(rf"\s*{_LETTER}?\s*", r.body[0]):
            r.body = []


def _scan_paragraphs(records: list[Record], book: Book) -> None:
    for r in records:
        t = r.row.clean
        head = 0
        if "\n" in t and title_core(t.split("\n", 1)[0]):
            head = t.index("\n") + 1
        cut: list[tuple[int, int]] = []

        def take(a: int, b: int) -> None:
            cut.append((a, b))

        for p in [_SPACED, _CAPITALS, *book.patterns]:
            for m in p.finditer(t, head):
                if p in (_SPACED, _CAPITALS) or _inside(t, m.start(), m.end()):
                    r.header = True
                    take(m.start(), m.end())
        tokens = list(_TOKEN.finditer(t)) if r.foreign else []
        starts = [(tokens[i].start(), tokens[min(i + TITLE_WORDS, len(tokens)) - 1].end()) for i in sorted(r.foreign) if i < len(tokens)]
        for x, y in [*starts, *((m.start(1), m.end(1)) for m in (_HAN_ISLAND.finditer(t) if r.row.lang == "zh" else ()))]:
            if x >= head and not any(a <= x < b for a, b in cut):
                r.header = True
                take(x, y)
        pages = r.row.source_pages if r.row.source_pages is not None and len(r.row.source_pages) else [r.row.page]
        spans = [x for x in numbers_in(t, set()) if x[0] >= head]
        plain = {x[:2] for x in numbers_in(t, r.counted)}
        titles = list(cut)
        for a, b, n, decorated in spans:
            if any(x <= a and b <= y for x, y in cut):
                continue
            near = any(0 <= a - y <= 3 or 0 <= x - b <= 3 for x, y in titles)
            off = min((abs(p - n - (book.offset or 0)) for p in pages), default=99)
            if decorated or (book.offset is not None and off == 0 or near and off <= 3) and (near or (a, b) in plain):
                cut.append((a, b))
                r.page_number |= not near
        for a, b in sorted(cut, reverse=True):
            t = t[:a].rstrip(" ") + " " + t[b:].lstrip(" ")
        r.body = [t]


def _inside(t: str, a: int, b: int) -> bool:
    """Does a known title stand in a text as a foreign body rather than as its words?"""
    before, after = t[:a].rstrip(), t[b:].lstrip()
    if not before:
        return False
    if "㐀" <= t[a] <= "鿿":
        return t[a - 1].isspace() and t[b : b + 1].isspace()
    return before[-1] not in "„“»‘「:" and (before[-1] not in _TERMINAL or not re.match(r"[a-zäöüß]", after) or t[a:b].isupper())


_BREAK = re.compile(rf"({_LETTER}+)-[ \t]*\n[ \t]*({_LETTER}+)")
_ENDS_BROKEN = re.compile(rf"({_LETTER}+)-\s*$")
_LEFT_BROKEN = re.compile(rf"({_LETTER}+)-\s+({_LETTER}+)")


def suspended(left: str, right: str, lang: str) -> bool:
    """Does the hyphen stand for the rest of a compound that is named once, at the end?"""
    return right in LINKED.get(lang, ()) and left[:1].isupper() and len(left) > 2


def belongs(left: str, right: str, lang: str, compounds: set[str]) -> bool:
    """Is the hyphen between two parts one of the word itself?"""
    return suspended(left, right, lang) or right[:1].isupper() or f"{left}-{right}".lower() in compounds


def _join(r: Record, after: Record | None, table: str, compounds: set[str]) -> None:
    t = "\n".join(r.body)

    def heal(m: re.Match) -> str:
        left, right = m.group(1), m.group(2)
        if suspended(left, right, r.row.lang):
            return f"{left}- {right}"
        if belongs(left, right, r.row.lang, compounds):
            return f"{left}-{right}"
        r.hyphen = True
        return left + right

    if "-" in t:
        t = (_BREAK if table == "block" else _LEFT_BROKEN).sub(heal, t)
    end = _ENDS_BROKEN.search(t) if t.rstrip().endswith("-") else None
    if end:
        following = re.match(rf"\s*({_LETTER}+)", "\n".join(after.body)) if after else None
        right = following.group(1) if following else ""
        if not (right and belongs(end.group(1), right, r.row.lang, compounds)):
            r.hyphen = True
            r.ends_broken = True
            if after:
                after.starts_broken = True
    join = "" if r.row.lang == "zh" else " "
    t = re.sub(r"[ \t]*\n[ \t]*", join, t)
    r.joined = re.sub(r"[ \t]{2,}", " ", t).strip(" \t")


#: A word of letters and digits; parts of words broken over records are none.
WORD = r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*"


@F.pandas_udf(T.StringType())
def _readable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else readable(t))


def corpus_records(ocr_blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Distinct records of both tables in one form; null and empty texts are kept, as records without a body."""
    blocks = ocr_blocks.select(F.lit("block").alias("rec_table"), "book", "lang", "chapter", F.col("block_id").alias("rec_id"), "page", F.col("block_idx").alias("ord"), "text", F.array("page").alias("source_pages"))
    return blocks.unionByName(
        paragraphs.select(F.lit("paragraph").alias("rec_table"), "book", "lang", "chapter", F.col("paragraph_id").alias("rec_id"), "page", F.col("paragraph").alias("ord"), "text", "source_pages")
    ).distinct()


def clean_records(records: DataFrame) -> DataFrame:
    """The records with ``clean``, their text in its readable form, and ``row``, a number; written once."""
    clean = F.coalesce(_readable(F.when(F.col("text").rlike(f"[^{PLAIN}]"), F.col("text"))), F.regexp_replace("text", "¬", "-"), F.lit(""))
    return materialize(records.withColumn("clean", clean).drop("text").withColumn("row", F.monotonically_increasing_id()), "p5-clean")


def token_facts(records: DataFrame) -> DataFrame:
    """(row, counted, foreign) of paragraphs: places of numbers that a neighbour counts by, and of capitals foreign to their sentence.

    Both are learned from all records: words that stand beside numbers again and again, and words that are small within
    sentences. Places and words meet in a join, so no word list has to be held.
    """
    bare = lambda x: F.lower(F.regexp_replace(x, r"^\P{L}+|\P{L}+$", ""))
    t = F.regexp_extract_all("clean", F.lit(_TOKEN.pattern), F.lit(0))
    near = lambda i: F.try_element_at(F.col("t"), i)
    facts = F.transform("t", lambda x, i: F.struct(
        i.alias("i"), x.alias("t"), F.when(i > 0, near(i)).alias("p"), near(i + 2).alias("n")
    ))
    tokens = records.filter("lang IS NOT NULL").select("row", "rec_table", "lang", t.alias("t")).select("row", "rec_table", "lang", F.explode(facts).alias("x")).select("row", "rec_table", "lang", "x.*")
    is_number = lambda c: F.coalesce(F.col(c).rlike(r"^[0-9]{1,4}$"), F.lit(False))
    inside = F.coalesce(F.right("p", F.lit(1)).rlike(r"[\p{L}\p{N},;]") & F.col("t").rlike(r"^\p{Lu}\p{Ll}*$"), F.lit(False))
    # what is asked of a token depends on its letters, the last letter before it and whether numbers are beside it: counted by these first
    kinds_of = tokens.groupBy("lang", "t", F.right("p", F.lit(1)).alias("p"), is_number("p").alias("pn"), is_number("n").alias("nn")).agg(F.count(F.lit(1)).alias("c"))
    count = lambda on: F.sum(F.when(on, F.col("c")).otherwise(0))
    words = kinds_of.withColumn("word", bare(F.col("t"))).filter("word <> ''").groupBy("lang", "word").agg(
        F.sum("c").alias("all"), count(F.col("t").rlike(r"^\P{L}*\p{Ll}")).alias("small"), count(inside).alias("capital"), count(F.col("nn")).alias("before"), count(F.col("pn")).alias("after")
    )
    often = lambda c: (F.col(c) >= COUNTS) & (F.col(c) >= COUNTING * F.col("all"))
    kinds = F.array(F.when(often("before"), F.lit("p")), F.when(often("after"), F.lit("n")), F.when((F.col("small") >= SMALL) & (F.col("capital") <= CAPITAL * F.col("small")), F.lit("t")))
    known = materialize(words.select("lang", "word", F.explode(F.array_compact(kinds)).alias("kind")), "p5-facts")
    number = is_number("t")
    asked = F.array(*[F.when(on, F.struct(F.lit(k).alias("kind"), bare(F.col(k)).alias("word"))) for k, on in (("p", number), ("n", number), ("t", inside))])
    places = tokens.filter("rec_table = 'paragraph'").filter(number | inside).select("row", "lang", "i", F.explode(F.array_compact(asked)).alias("x")).select("row", "lang", "i", "x.*")
    found = places.join(known, ["lang", "word", "kind"], "left_semi")
    gather = lambda on: F.collect_set(F.when(on, F.col("i")))
    return found.groupBy("row").agg(gather(F.col("kind") != "t").alias("counted"), gather(F.col("kind") == "t").alias("foreign"))


def learn_furniture(records: DataFrame) -> DataFrame:
    """Per (rec_table, book, lang): titles, heads and the offset of page numbers, from all records of the book."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def said(table: pd.Series, text: pd.Series, pages: pd.Series, counted: pd.Series) -> pd.Series:
        lists = lambda x: [] if x is None else list(x)
        return pd.Series([[{"kind": k, "value": v} for k, v in hints(a, t, lists(p), set(lists(c)))] for a, t, p, c in zip(table, text, pages, counted)])

    told = records.select("rec_table", "book", "lang", "chapter", "page", F.explode(said("rec_table", "clean", "source_pages", "counted")).alias("h"))
    keys = ["rec_table", "book", "lang"]
    counted = told.groupBy(*keys, "h").agg(F.countDistinct("chapter", "page").alias("n"))
    kept = counted.filter((F.col("h.kind") != "title") | (F.col("n") >= TITLE_PAGES))
    pick = lambda kind: F.collect_set(F.when(F.col("h.kind") == kind, F.col("h.value")))
    offset = F.max(F.when((F.col("h.kind") == "offset") & (F.col("n") > 1), F.struct("n", -F.abs(F.col("h.value").cast("int")), F.col("h.value").cast("int").alias("offset"))))
    return kept.groupBy(*keys).agg(pick("title").alias("titles"), pick("head").alias("heads"), offset["offset"].alias("offset"))


def compounds_of(records: DataFrame) -> DataFrame:
    """(word) hyphenated within lines more often than the same letters stand joined, twice at least."""
    letters = r"\p{L}+"
    text = F.lower("clean")
    inline = records.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}-])({letters}-{letters})(?![\p{{L}}-])"), F.lit(1))).alias("word"))
    counts = inline.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("joined", F.regexp_replace("word", "-", ""))
    plain = records.select(F.explode(F.regexp_extract_all(text, F.lit(letters), F.lit(0))).alias("joined")).groupBy("joined").agg(F.count(F.lit(1)).alias("m"))
    return counts.join(plain, "joined", "left").filter("m IS NULL OR m < n").select("word")


SCANNED = "rec_table string, book string, lang string, chapter int, rec_id string, page int, ord int, header boolean, page_number boolean, hyphen boolean, body string, starts_broken boolean, ends_broken boolean"


def scan(records: DataFrame) -> DataFrame:
    """Furniture and broken words of all records, with the body text and words that are left; one row per distinct record.

    A chapter is one task, with what is known of its book beside it: its titles, and of the compounds those that its
    own broken words may be.
    """
    records = clean_records(records)
    records = records.join(token_facts(records), "row", "left")
    group = ["rec_table", "book", "lang", "chapter"]
    same = lambda a, b, keys: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"of_{k}"]) for k in keys])
    chapters = records.select(*group).distinct()
    books = learn_furniture(records).withColumnsRenamed({k: f"of_{k}" for k in group[:3]})
    told = chapters.join(books, same(chapters, books, group[:3]), "left").select(*group, "titles", "heads", "offset", F.lit(None).cast("string").alias("word"))
    # words broken at the end of a line or text, with the beginning of the next record of the chapter
    nothing = F.array().cast("array<string>")
    broken = records.filter(F.col("clean").rlike(r"\p{L}-\s")).select(*group, F.explode(F.regexp_extract_all(F.lower("clean"), F.lit(r"\p{L}+-\s+\p{L}+"), F.lit(0))).alias("w")).select(*group, F.regexp_replace("w", r"\s+", "").alias("word"))
    over = records.filter(F.col("clean").rlike(r"\p{L}-\s*$")).select(*group, F.lower(F.regexp_extract("clean", r"(\p{L}+)-\s*$", 1)).alias("left"))
    compounds = materialize(compounds_of(records), "p5-compounds")
    across = over.join(compounds.select("word", F.substring_index("word", "-", 1).alias("left")), "left").select(*group, "word")
    mine = broken.join(compounds, "word", "left_semi").unionByName(across, allowMissingColumns=True).select(*group, "word").distinct()
    told = told.unionByName(mine.select(*group, nothing.alias("titles"), nothing.alias("heads"), F.lit(None).cast("int").alias("offset"), "word"))
    names = [x.split(" ", 1)[0] for x in SCANNED.split(", ")]

    def run(key, pdf: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "ord", "rec_id", "row"], ignore_index=True)
        if pdf.empty:
            return pd.DataFrame([], columns=names)
        compounds = {w for w in facts.word if w is not None}
        known = facts[facts.word.isna()]
        lists = [[] if not len(known) or known[c].iloc[0] is None else list(known[c].iloc[0]) for c in ("titles", "heads")]
        offset = None if not len(known) or pd.isna(known.offset.iloc[0]) else int(known.offset.iloc[0])
        out = []
        for r in scan_chapter(list(pdf.itertuples()), pdf.rec_table.iloc[0], Book(*lists, offset), compounds):
            out.append((r.row.rec_table, r.row.book, r.row.lang, r.row.chapter, r.row.rec_id, r.row.page, r.row.ord, r.header, r.page_number, r.hyphen, r.joined, r.starts_broken, r.ends_broken))
        return pd.DataFrame(out, columns=names)

    facts = spread(told.withColumnsRenamed({k: f"of_{k}" for k in group}), *[f"of_{k}" for k in group]).groupBy(*[f"of_{k}" for k in group])
    scanned = spread(records, *group).groupBy(*group).cogroup(facts).applyInPandas(run, SCANNED)
    words = F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    first, cut = F.col("starts_broken").cast("int"), F.col("starts_broken").cast("int") + F.col("ends_broken").cast("int")
    return scanned.withColumn("words", F.slice(words, first + 1, F.greatest(F.size(words) - cut, F.lit(0))))


def word_counts(texts: DataFrame, words: str = "words") -> DataFrame:
    """(lang, word, n) over all texts."""
    return texts.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


#: The letters of a word without one or two neighbouring ones, and those.
_WINDOWS = "flatten(transform(array(1, 2), k -> transform(sequence(1, greatest(length(word) - k + 1, 1)), i -> named_struct('key', concat(left(word, i - 1), '\\u0001', substr(word, i + k)), 'part', substr(word, i, k)))))"


def word_pairs(counts: DataFrame) -> DataFrame:
    """(lang, word, n, known, m, seen, meant, rare): words of three letters or more that differ in one place, by one or two
    letters for one or two others: ``seen`` in the word, ``meant`` in the known one.

    A known word occurs 1 / RARITY times or more. ``rare`` tells the words that occur at most RARITY as often as the
    known one from those that are as common. Words meet by the letters they share, at least two: a key holds fewer
    words than there are pairs of letters, whatever the size of the corpus. Runs of scripts without upper and lower
    case are no words here, and a difference of case is none.
    """
    cased = counts.filter((F.length("word") > 2) & (F.upper("word") != F.lower("word")))
    spread_out = cased.withColumn("x", F.explode(F.filter(F.expr(_WINDOWS), lambda x: F.length(x["key"]) > 2))).select("lang", "word", "n", F.col("x.key").alias("key"), F.col("x.part").alias("seen"))
    known = spread_out.filter(F.col("n") * RARITY >= 1).select("lang", "key", F.col("word").alias("known"), F.col("n").alias("m"), F.col("seen").alias("meant"))
    differ = lambda f: f("seen") != f("meant")
    rare, common = F.col("n") <= RARITY * F.col("m"), (F.col("n") * RARITY >= 1) & (F.col("m") > RARITY * F.col("n"))
    return spread_out.join(known, ["lang", "key"]).filter(differ(lambda c: F.left(F.col(c), F.lit(1))) & differ(lambda c: F.right(F.col(c), F.lit(1))) & differ(lambda c: F.lower(c)) & (rare | common)).select("lang", "word", "n", "known", "m", "seen", "meant", rare.alias("rare"))


def link_words(counts: DataFrame) -> DataFrame:
    """(lang, word, known, score): words linked to known ones ten times as frequent, by edits that are glyph confusions.

    Which edits those are is learned: a confusion turns many words into rare ones, while words that are merely alike
    are as often alike when both are common. The score is the logarithm of the links of an edit of the one kind
    against the other, less what there are more of the one in all, plus PRIOR for each power of ten by which the word
    is rarer. Links of any score come out; the contexts decide.
    """
    pairs = materialize(word_pairs(counts), "p5-pairs")
    links, alike = F.count(F.when(F.col("rare"), F.lit(1))), F.count(F.when(~F.col("rare"), F.lit(1)))
    edits = materialize(pairs.groupBy("seen", "meant").agg(links.alias("r"), alike.alias("c")), "p5-edits")
    total = edits.agg(F.sum("r").alias("r"), F.sum("c").alias("c")).first()
    more = max(0.0, math.log(((total.r or 0) + FEW) / ((total.c or 0) + FEW)))
    edits = edits.filter("r > 0").select("seen", "meant", (F.log((F.col("r") + GRANTED[0]) / (F.col("c") + GRANTED[1])) - more).alias("edit"))
    linked = pairs.filter("rare").join(edits, ["seen", "meant"])
    return linked.groupBy("lang", "word", "known").agg(F.max(F.col("edit") + PRIOR * F.log10(F.col("m") / F.col("n"))).alias("score"))


class Vectors:
    """Unit skip-gram vectors of the words of a bounded vocabulary, and of the classes of all other words."""

    def __init__(self, keys: list[str], matrix: np.ndarray):
        self.keys = pa.array(keys, pa.string())
        # what all words share tells nothing; the last row stands for what was never seen in training
        m = matrix - matrix.mean(axis=0) if len(matrix) else matrix
        self.matrix = np.vstack([m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9), np.zeros((1, DIMENSIONS))])

    def rows(self, keys: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), len(self.keys)).to_numpy(zero_copy_only=False)


def _tagged(langs: pa.Array, words: pa.ListArray, vocabulary: pa.Array) -> pa.Array:
    """Every word of a batch with its language, words outside the vocabulary as their class: number, capital or small."""
    of = pc.take(langs, pc.list_parent_indices(words))
    flat = words.flatten()
    key = pc.binary_join_element_wise(of, flat, ":")
    first = pc.utf8_slice_codeunits(flat, 0, 1)
    kind = pc.if_else(pc.match_substring_regex(flat, r"\p{Nd}"), "#", pc.if_else(pc.not_equal(first, pc.utf8_lower(first)), "A", "a"))
    return pc.if_else(pc.is_valid(pc.index_in(key, value_set=vocabulary)), key, pc.binary_join_element_wise(of, kind, "::"))


def learn_vectors(texts: DataFrame, counts: DataFrame, max_words: int = MAX_WORDS, part: int = TRAINED) -> Vectors:
    """Skip-gram vectors trained on the words of all texts, in one partition for each ``part`` words.

    The model has a bound: words that make up more than 1 / ``max_words`` of their language have a vector of their own,
    so at most that many a language; every other word takes part, as one of its class.
    """
    from pyspark.ml.feature import Word2Vec

    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").filter(F.col("n") * max_words > F.col("total"))
    rows = frequent.select(F.concat_ws(":", "lang", "word").alias("key")).collect()
    shared = texts.sparkSession.sparkContext.broadcast(sorted(r.key for r in rows))
    size = totals.agg(F.sum("total").alias("n")).first().n or 0
    if not size:
        return Vectors([], np.zeros((0, DIMENSIONS)))

    def run(batches):
        vocabulary = pa.array(shared.value, pa.string())
        for b in batches:
            words = b.column(1)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(list_bounds(words).astype(np.int32)), _tagged(b.column(0), words, vocabulary))], ["words"])

    tagged = texts.select("lang", "words").mapInArrow(run, "words array<string>")
    model = Word2Vec(vectorSize=DIMENSIONS, windowSize=WINDOW, minCount=1, maxIter=1, seed=7, numPartitions=max(1, round(size / part)), inputCol="words", outputCol="v").fit(tagged)
    found = sorted(model.getVectors().collect(), key=lambda r: r.word)
    return Vectors([r.word for r in found], np.array([r.vector.toArray() for r in found]).reshape(-1, DIMENSIONS))


def list_bounds(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def slices(batch: pa.RecordBatch, words: pa.ListArray):
    """Parts of a batch of at most AT_ONCE words, or of one text, so that what is made of every word stays small."""
    bounds = list_bounds(words)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + AT_ONCE, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def word_contexts(texts: DataFrame, vectors: Vectors, wanted: np.ndarray) -> DataFrame:
    """Contexts, the mean vectors of the words around: summed up by word (``at`` null), and of every occurrence of a word
    whose bit in ``wanted`` is set: (rec_table, rec_id, page, ord, at, lang, word, n, context)."""
    shared = texts.sparkSession.sparkContext.broadcast((vectors, wanted))
    keep = ["rec_table", "rec_id", "page", "ord"]

    def run(batches):
        vectors, bits = shared.value
        for b in (part for whole in batches for part in slices(whole, whole.column(5))):
            words, langs = b.column(5), b.column(4)
            bounds = list_bounds(words)
            n = np.diff(bounds)
            own = vectors.matrix[vectors.rows(_tagged(langs, words, vectors.keys))]
            sums = np.vstack([np.zeros((1, DIMENSIONS)), np.cumsum(own, axis=0)])
            i = np.arange(bounds[-1])
            context = sums[np.minimum(i + WINDOW + 1, np.repeat(bounds[1:], n))] - sums[np.maximum(i - WINDOW, np.repeat(bounds[:-1], n))] - own
            context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
            text = pc.list_parent_indices(words)
            key = pc.dictionary_encode(pc.binary_join_element_wise(pc.take(langs, text), words.flatten(), ":"))
            code = key.indices.to_numpy(zero_copy_only=False)
            names = key.dictionary.to_pylist()
            summed = np.zeros((len(names), DIMENSIONS))
            np.add.at(summed, code, context)
            hit = np.array([bits[bit_of(k)] for k in names], bool)[code] if names else np.zeros(0, bool)
            at = pa.array(np.flatnonzero(hit))
            vec = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, DIMENSIONS, dtype=np.int32)), pa.array(m.astype(np.float32).ravel()))
            lang, word = [k.split(":", 1)[0] for k in names], [k.split(":", 1)[1] for k in names]
            none = [pa.nulls(len(names), b.column(c).type) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(len(names), pa.int32()), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(np.bincount(code, minlength=len(names))), vec(summed)], out)
            of = pc.take(text, at)
            rows = [pc.take(b.column(c), of) for c in range(5)]
            place = (i - np.repeat(bounds[:-1], n))[hit].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows[:4], pa.array(place), rows[4], pc.take(words.flatten(), at), pa.array(np.ones(len(place), np.int64)), vec(context[hit])], out)

    out = [*keep, "at", "lang", "word", "n", "context"]
    return texts.select(*keep, "lang", "words").mapInArrow(run, "rec_table string, rec_id string, page int, ord int, at int, lang string, word string, n bigint, context array<float>")


def bit_of(key: str) -> int:
    return crc32(key.encode()) % BITS


def correct(scanned: DataFrame) -> DataFrame:
    """Corrections in context: (rec_table, rec_id, page, ord, at, word, correct) for each misread word of the bodies.

    A misread word stands where the word that was meant stands. So the mean of its contexts must be no further from the
    known word's mean than chance explains for so many occurrences: the more they are apart, the less the link counts.
    Where it stands, its context must be nearer to that of the known word than to the mean of all, and decides between
    several known words. Words without neighbours have no context to object. Records without words or language are
    left as they are.
    """
    texts = scanned.filter((F.size("words") > 0) & F.col("lang").isNotNull())
    counts = materialize(word_counts(texts), "p5-words")
    links = materialize(link_words(counts), "p5-links")
    # a bit for every linked word: a bounded filter that spares the other occurrences the joins below
    set_bits = links.select((F.crc32(F.concat_ws(":", "lang", "word").cast("binary")) % BITS).cast("int").alias("b")).distinct().collect()
    wanted = np.zeros(BITS, bool)
    wanted[[r.b for r in set_bits]] = True
    contexts = materialize(word_contexts(texts, learn_vectors(texts, counts), wanted), "p5-contexts")
    sums = contexts.filter("at IS NULL")
    total = lambda: [F.sum(F.col("context")[i]).alias(f"c{i}") for i in range(DIMENSIONS)]
    middle = sums.agg(F.sum("n").alias("n"), *total()).first()
    common = F.array(*[F.lit((middle[f"c{i}"] or 0.0) / max(middle.n or 0, 1)) for i in range(DIMENSIONS)])
    linked = links.select("lang", F.explode(F.array("word", "known")).alias("word")).distinct()
    profiles = sums.join(linked, ["lang", "word"], "left_semi").groupBy("lang", "word").agg(F.sum("n").alias("m"), *total())
    profiles = materialize(profiles.select("lang", "word", "m", F.array(*[F.col(f"c{i}") / F.col("m") for i in range(DIMENSIONS)]).alias("profile")), "p5-profiles")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    both = links.join(profiles.withColumnRenamed("profile", "own"), ["lang", "word"]).join(profiles.select("lang", F.col("word").alias("known"), "profile"), ["lang", "known"])
    # contexts are unit vectors: what their mean lacks in length is how much they scatter
    scatter = F.greatest(1 - norm(F.col("profile")), F.lit(0.05))
    strange = F.log(F.greatest(F.col("m") * apart(F.col("own"), F.col("profile")) / scatter, F.lit(1.0)))
    both = both.withColumn("score", F.col("score") - STRANGE * strange).filter(F.col("score") >= CERTAIN)
    u = F.col("context").cast("array<double>")
    here = F.when(norm(u) > 0, (apart(u, common) - apart(u, F.col("profile"))) / scatter).otherwise(0.0)
    judged = contexts.filter("at IS NOT NULL").drop("n").join(both, ["lang", "word"]).withColumn("here", here).filter("here >= 0")
    place = ["rec_table", "rec_id", "page", "ord", "at", "word"]
    best = F.max(F.struct(F.round(F.col("score") + HERE * F.col("here"), 3).alias("score"), "known"))
    return judged.groupBy(*place).agg(best.alias("best")).select(*place, F.col("best.known").alias("correct"))


def defects(scanned: DataFrame, corrections: DataFrame) -> DataFrame:
    """Distinct (rec_table, rec_id, kind) of all defects."""
    flags = F.array(*[F.when(F.col(k), F.lit(k)) for k in ("header", "page_number", "hyphen")])
    found = scanned.select("rec_table", "rec_id", F.explode(F.array_compact(flags)).alias("kind"))
    return found.unionByName(corrections.select("rec_table", "rec_id", F.lit("misread").alias("kind"))).distinct()


def reflow(scanned: DataFrame, corrections: DataFrame) -> DataFrame:
    """Continuous paragraphs: (rec_table, book, lang, chapter, paragraph, text, rec_ids).

    Words are corrected, empty bodies dropped, a repeated record taken once, and a record is joined to the one before
    when that ends within a word or a sentence.
    """
    fixes = corrections.groupBy("rec_table", "rec_id", "page", "ord").agg(F.collect_set(F.struct("word", "correct")).alias("fixes"))
    keys = ["rec_table", "rec_id", "page", "ord"]
    rows = scanned.join(fixes, keys, "left").select("rec_table", "book", "lang", "chapter", "rec_id", "page", "ord", "body", "ends_broken", "fixes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "ord", "rec_id"], ignore_index=True).drop_duplicates("rec_id")
        out: list[list] = []
        broken = False
        for r in pdf.itertuples():
            t = r.body.strip(" \t")
            if not t.strip("　"):
                continue
            for f in [] if r.fixes is None else r.fixes:
                t = re.sub(rf"(?<!\w){re.escape(f['word'])}(?!\w)", lambda _, c=f["correct"]: c, t)
            fresh = t.startswith("　")
            t = t.strip("　 ")
            if out and not fresh and (broken or out[-1][0][-1:] not in _TERMINAL):
                last = out[-1][0]
                out[-1][0] = last.rstrip("- ") + t if broken else last + ("" if r.lang == "zh" else " ") + t
                out[-1][1].append(r.rec_id)
            else:
                out.append([t, [r.rec_id]])
            broken = bool(r.ends_broken)
        k = pdf.iloc[0]
        return pd.DataFrame([(k.rec_table, k.book, k.lang, k.chapter, i + 1, t, ids) for i, (t, ids) in enumerate(out)], columns=["rec_table", "book", "lang", "chapter", "paragraph", "text", "rec_ids"])

    return rows.groupBy("rec_table", "book", "lang", "chapter").applyInPandas(run, "rec_table string, book string, lang string, chapter int, paragraph int, text string, rec_ids array<string>")
