"""Sentence boundaries across languages and scripts.

Statistics are learned without supervision per language from the whole corpus, all by log-likelihood ratios: which words
carry a period that ends nothing (abbreviations), which pairs span such periods (collocations), which words start
sentences, and which words tell who speaks around a quotation. They stay tables: what they say of the words of a text is
joined to it, so no list has to be held. A reader then walks each text once, knows quotation, bracket and title depth,
and classifies every mark that looks like an end with them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .looks import form_of, is_plain, mapping

#: Thresholds of the log-likelihood ratios, as published for unsupervised boundary detection.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: A collocation makes up this part of what follows the abbreviation before a capital; large corpora find any deviation.
COLLOCATION_SHARE = 0.3
#: A word tells who speaks when this part of its occurrences stands where nothing else can.
SPEECH_SHARE = 0.25
#: Tokens whose evidence the abbreviation threshold is meant for: evidence counts per so many tokens at every size of corpus.
EVIDENCE = 250_000

_WS = r"\p{IsWhite_Space}"
_EDGE = "\"'„“”‚‘’»«›‹「」『』()（）[]《》—–"


@dataclass
class Periods:
    """What is known of the words of a text or of a language."""

    inner: set[str] = field(default_factory=set)  # abbreviations that never end a sentence before a capital
    final: set[str] = field(default_factory=set)  # abbreviations that may also end one
    starters: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    speech: set[str] = field(default_factory=set)  # words, in scripts without blanks the last two characters, of who speaks


def _llr(k1, n1, k2, n2):
    """Twice the log-likelihood ratio of two binomials, as a column."""
    n1, n2 = F.greatest(n1, F.lit(1.0)), F.greatest(n2, F.lit(1.0))
    near = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    ll = lambda k, n, p: k * F.log(near(p)) + (n - k) * F.log(1 - near(p))
    return 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, (k1 + k2) / (n1 + n2)) - ll(k2, n2, (k1 + k2) / (n1 + n2)))


_BARE = lambda x: F.regexp_replace(F.regexp_replace(x, f"^[{re.escape(_EDGE)}]+", ""), f"[{re.escape(_EDGE)},;:!?…]+$", "")


def _tokens(texts: DataFrame, text: str, *keep: str, where=None) -> DataFrame:
    """(*keep, t, n, last): every token of a text that meets a condition, the next one, and whether there is none."""
    clash = "_" * max(map(len, [*keep, text]))
    parts = texts.select(*keep, F.filter(F.split(text, rf"{_WS}+"), lambda x: x != "").alias(clash))  # made once, not for every token
    at = F.transform(F.col(clash), lambda x, i: F.struct(x.alias("t"), F.try_element_at(F.col(clash), i + 2).alias("n"), (i + 1 == F.size(clash)).alias("last")))
    return parts.select(*keep, F.explode(at if where is None else F.filter(at, where)).alias(clash)).select(*keep, f"{clash}.*")


def token_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of all texts: (lang, type, n) of every type, and (lang, type, next_type, next_case, c) of those with a period;
    the last token of a text has next_case 'end'.

    ``type`` is lower case without outer quotes, brackets and the final period; cases are lower, upper, digit, other.
    Equal tokens are counted before their letters are looked at.
    """
    texts = texts.filter(F.length("text") > 0)
    type_of = lambda x: F.lower(F.regexp_replace(_BARE(x), r"\.$", ""))
    told = texts.select("lang", F.explode(F.split("text", rf"{_WS}+")).alias("t")).groupBy("lang", "t").agg(F.count(F.lit(1)).alias("c"))
    every = told.select("lang", type_of(F.col("t")).alias("type"), "c").filter(F.col("type").rlike(r"\p{L}")).groupBy("lang", "type").agg(F.sum("c").alias("n"))
    over = _tokens(texts, "text", "lang", where=lambda x: x["t"].contains(".") & ~x["t"].endswith(",")).groupBy("lang", "t", "n", "last").agg(F.count(F.lit(1)).alias("c"))
    t, n = _BARE(F.col("t")), _BARE(F.col("n"))
    case = F.when(F.col("last"), "end").when(n.rlike(r"^\p{Ll}"), "lower").when(n.rlike(r"^\p{Lu}"), "upper").when(n.rlike(r"^\p{N}"), "digit").otherwise("other")
    pairs = over.filter(t.rlike(r"[^.]\.$")).select("lang", type_of(F.col("t")).alias("type"), type_of(F.col("n")).alias("next_type"), case.alias("next_case"), "c")
    return every, pairs.filter(F.col("type").rlike(r"\p{L}")).groupBy("lang", "type", "next_type", "next_case").agg(F.sum("c").alias("c"))


#: What a quotation is surely followed by when it ends with a comma or a small letter follows: words of who speaks, up to a mark.
_CLOSE = "\"”“’»«›‹」』"
_SAID = rf"(?:[,，][\"”’»«›‹」』]|(?<=[!?！？])[{_CLOSE}](?=\s\p{{Ll}}))[ ]?([^{_CLOSE}„‘「『.,;:!?…。，；：！？]+)"
_BEHIND = rf"[{_CLOSE}]((?:[^{_CLOSE}„‘「『.!?。！？]*\.)?[^{_CLOSE}„‘「『.!?。！？]*[。.,，]?)"
_UNSURE = rf"[.!?！？。…][{_CLOSE}][ ]?(?!\p{{Ll}})([^{_CLOSE}„‘「『.,;:!?…。，；：！？]+)"
_CLAUSE = r"([㐀-鿿]{2})(?=[。，！？])"


def speech_words(texts: DataFrame, types: DataFrame) -> DataFrame:
    """(lang, word) that tell who speaks: far more often after a quotation that surely goes on than elsewhere.

    In scripts without blanks the last two characters of a clause stand for the word.
    """

    def after(pattern: str, name: str) -> DataFrame:
        said = texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("s"))
        words = F.filter(F.split("s", " "), lambda w: w.rlike(r"^\p{Ll}{2,}$"))
        endings = F.when(F.col("s").rlike("[㐀-鿿]{2}$"), F.array(F.right("s", F.lit(2)))).otherwise(words)
        return said.select("lang", F.explode(endings).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias(name))

    sure, unsure = after(_SAID, "k"), after(_UNSURE, "u")
    clauses = texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(_CLAUSE), F.lit(1))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    known = types.select("lang", F.col("type").alias("word"), "n").unionByName(clauses).groupBy("lang", "word").agg(F.max("n").alias("n"))
    n1 = sure.groupBy("lang").agg(F.sum("k").cast("double").alias("n1"))
    n2 = known.groupBy("lang").agg(F.sum("n").cast("double").alias("n2"))
    # what stands after a quotation that may have ended tells nothing
    found = sure.join(known, ["lang", "word"]).join(unsure, ["lang", "word"], "left").withColumn("n", F.greatest(F.col("n") - F.coalesce("u", F.lit(0)), F.col("k"))).join(F.broadcast(n1), "lang").join(F.broadcast(n2), "lang")
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    return found.filter((k >= SPEECH_SHARE * n) & (k / F.col("n1") > (n - k) / F.col("n2")) & (_llr(k, F.col("n1"), n - k, F.col("n2") - F.col("n1")) >= STARTER)).select("lang", "word")


def learn_periods(texts: DataFrame) -> DataFrame:
    """(lang, kind, word, next) of all that ``texts`` (lang, text) tell; null texts and languages are left out.

    Kinds: ``inner`` abbreviations never end a sentence before a capital, ``final`` ones may; ``starter``; ``collocation``
    of an abbreviation with ``next``; ``speech``. Counts cover all rows; nothing is cut for being rare or long.
    """
    texts = texts.filter("lang IS NOT NULL AND text IS NOT NULL")
    every, pairs = token_counts(texts)
    pairs = materialize(pairs, "p7-pairs")
    weigh = lambda on: F.coalesce(F.sum(F.when(on, F.col("c"))), F.lit(0)).cast("double")
    cases = ("lower", "upper", "digit", "end")
    over = pairs.groupBy("lang", "type").agg(F.sum("c").cast("double").alias("with"), F.count_distinct("next_type").alias("followers"), *[weigh(F.col("next_case") == c).alias(c) for c in cases])
    types = materialize(every.withColumn("n", F.col("n").cast("double")).join(over, ["lang", "type"], "left").fillna(0, ["with", "followers", *cases]), "p7-types")
    totals = types.groupBy("lang").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "with", "end", "upper")])
    t = types.filter(F.col("with") > 0).join(F.broadcast(totals), "lang")
    c = F.col
    dots = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - dots
    ll = _llr(c("with"), c("n"), c("all_with") - c("with"), c("all_n") - c("n"))
    # the published score, of evidence per so many tokens, where the evidence at hand is no accident
    score = F.when((c("with") / c("n") > c("all_with") / c("all_n")) & (ll >= COLLOCATION), ll * F.least(F.lit(1.0), EVIDENCE / c("all_n"))).otherwise(0.0)
    score = score * F.exp(-letters.cast("double")) * (dots + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -20 * (c("n") - c("with")) / c("n"))
    # a word that merely stands at sentence ends also ends texts and is never followed by a small letter or number
    expected = c("with") * c("all_end") / F.greatest(c("all_with"), F.lit(1.0))
    inside = (c("lower") + c("digit")) / c("with") >= 0.1
    never_last = (c("end") <= 0.1 * expected) & (expected >= 2) & (c("followers") >= 3)
    single = c("type").rlike(r"^\p{L}$")
    dotted = (dots > 0) & (c("upper") + c("lower") + c("digit") + c("end") > 0) & ~c("type").rlike(r"\.\.|\p{N}") & (letters <= 2 * (dots + 1))
    ends_too = ~single & (inside & (c("upper") + c("end") > 0) & ~never_last | (dots > 0) & ~inside & (c("end") > 0.1 * expected))
    known = t.filter((score >= ABBREVIATION) & (inside | never_last) | dotted | single).select("lang", F.when(ends_too, "final").otherwise("inner").alias("kind"), F.col("type").alias("word"))
    known = materialize(known, "p7-abbreviations")
    after = pairs.filter("next_type <> ''")
    short = known.select("lang", F.col("word").alias("type"))
    first = after.filter("next_case = 'upper'").join(short, ["lang", "type"], "left_anti").groupBy("lang", F.col("next_type").alias("type")).agg(F.sum("c").cast("double").alias("k"))
    s = first.join(types.select("lang", "type", "n"), ["lang", "type"]).join(F.broadcast(totals), "lang")
    rest = F.greatest(c("n") - c("k"), F.lit(0.0))
    starters = s.filter((c("k") / c("all_with") > rest / F.greatest(c("all_n") - c("all_with"), F.lit(1.0))) & (_llr(c("k"), c("all_with"), rest, c("all_n") - c("all_with")) >= STARTER)).select("lang", F.col("type").alias("word"))
    # pairs over the period of an abbreviation before a capital, against how often that word follows any period
    capitals = after.filter("next_case = 'upper'")
    firsts = capitals.groupBy("lang", "next_type").agg(F.sum("c").cast("double").alias("b"))
    spans = capitals.join(short, ["lang", "type"], "left_semi").groupBy("lang", "type", "next_type").agg(F.sum("c").cast("double").alias("k"))
    p = spans.join(types.select("lang", "type", F.col("upper").alias("a")), ["lang", "type"]).join(firsts, ["lang", "next_type"]).join(F.broadcast(totals), "lang")
    collocations = p.filter((c("k") > 1) & (c("k") >= COLLOCATION_SHARE * c("a")) & (c("k") / c("a") > c("b") / c("all_upper")) & (_llr(c("k"), c("a"), c("b") - c("k"), c("all_upper") - c("a")) >= COLLOCATION))
    none = F.lit(None).cast("string").alias("next")
    facts = known.select("lang", "kind", "word", none).unionByName(starters.select("lang", F.lit("starter").alias("kind"), "word", none))
    facts = facts.unionByName(collocations.select("lang", F.lit("collocation").alias("kind"), F.col("type").alias("word"), F.col("next_type").alias("next")))
    return materialize(facts.unionByName(speech_words(texts, types).select("lang", F.lit("speech").alias("kind"), "word", none)), "p7-facts")


def periods_of(facts) -> Periods:
    """Rows (kind, word, next) as sets."""
    p = Periods()
    into = {"inner": p.inner, "final": p.final, "starter": p.starters, "speech": p.speech}
    for f in facts if facts is not None else ():
        if f["kind"] == "collocation":
            p.collocations.add((f["word"], f["next"]))
        else:
            into[f["kind"]].add(f["word"])
    return p


def facts_of(spark: SparkSession, periods: dict[str, Periods]) -> DataFrame:
    """Sets that are given by hand as a table of facts."""
    rows = []
    for lang, p in periods.items():
        for kind, words in (("inner", p.inner), ("final", p.final), ("starter", p.starters), ("speech", p.speech)):
            rows += [(lang, kind, w, None) for w in sorted(words)]
        rows += [(lang, "collocation", a, b) for a, b in sorted(p.collocations)]
    return spark.createDataFrame(rows, "lang string, kind string, word string, next string")


_OPEN = {"„": "“", "‚": "‘", "“": "”", "‘": "’", "»": "«", "›": "‹", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "〈": "〉"}
_CLOSERS = set("“”’‘»«›‹」』)）]》〉\"'")
_TITLES = set("《〈")
_BRACKETS = set("(（[")
_MARKS = set(".!?…。！？")
#: Characters at which the reader has to decide something.
_TELLING = re.compile("[" + re.escape("".join(sorted({"\n", *_OPEN, *_CLOSERS, *_MARKS}))) + "]")
_HAN = re.compile(r"[㐀-鿿]")
_BLANKS = re.compile(r"\s*")
_NOISE = re.compile(r"(?:[\s\x80-\x9f]*(?:[-–—\[(·*]*\s*\d{1,4}\s*[-–—\])·*]*)(?=[\s\x80-\x9f]))?[\s\x80-\x9f]*")
#: Page leftovers that can stand between a quotation and the words of saying.
_LEFTOVER = re.compile(r"[\x80-\x9f]+\s*\d*\s*[\x80-\x9f]*|(?:\b\w\s+){3,}\w\b|(?<!\w)\d{1,4}(?!\w)|(?<=\w)[-‐¬\xad]\s+(?=[a-zäöüß])")
_UP_TO_MARK = re.compile(r"[^.!?…。！？，,;:；：“”„»«「」‘’\"]*")
_FIRST_WORD = re.compile(r"[\"'„“‚‘»›「『(（\[《]*([\w-]+)")


def _said_after(t: str, at: int, periods: Periods) -> bool:
    """Do the words after a quotation, which begin like a sentence, say who spoke it rather than start anew?"""
    while True:
        m = _UP_TO_MARK.match(t, at)
        clause = re.sub(r"\s+", " ", _LEFTOVER.sub("", m.group())).strip()
        if t[m.end() : m.end() + 1] == "." and clause.rsplit(" ", 1)[-1].lower() in periods.inner and clause:
            at = m.end() + 1  # an abbreviation before a name
            continue
        break
    if _HAN.match(clause[-1:]):
        return clause[-2:] in periods.speech and t[m.end() : m.end() + 1] in ("。", "，", ".", ",")
    leads_on = t[m.end() : m.end() + 1] == "," and re.match(r"\s*[“‘\"]", t[m.end() + 1 : m.end() + 4])
    words = clause.split(" ")
    for k, w in enumerate(words):
        if w in periods.speech:
            return not (leads_on and k == len(words) - 1)  # else it leads to the next quotation
    return False


def _visible(text: str) -> tuple[str, list[int]]:
    """The text without invisible characters and with one kind of space and letter, and the end of each character in it."""
    if is_plain(text):
        return text, range(1, len(text) + 1)
    table, chars, ends = mapping(), [], []
    for i, c in enumerate(text):
        v = table.get(c, c)
        for x in v:
            chars.append(x)
            ends.append(i + 1)
    return "".join(chars), ends


def _closes(t: str, i: int, stack: list[tuple[str, int]]) -> bool:
    """Does the character close the innermost quotation or bracket? An apostrophe between letters does not."""
    c = t[i]
    if not stack or _OPEN.get(stack[-1][0]) != c and not (stack[-1][0] == c == '"'):
        return False
    return not (c == "’" and i + 1 < len(t) and t[i + 1].isalpha() and t[i - 1].isalpha())


def boundaries(text: str, lang: str, periods: Periods) -> list[int]:
    """Ends of all sentences that another sentence follows, in code points of ``text``."""
    t, ends = _visible(text)
    n = len(t)
    out: list[int] = []
    stack: list[tuple[str, int]] = []
    first = start = _BLANKS.match(t).end()

    def capital(j: int) -> bool:
        """Can the text from there on start a sentence, with a capital, a number or a script without cases?"""
        w = _FIRST_WORD.match(t, j)
        return bool(w) and (w.group(1)[0].isupper() or bool(_HAN.match(w.group(1)[0])) or w.group(1)[0].isdigit())

    i = start
    while m := _TELLING.search(t, i):
        i = m.start()
        c = t[i]
        if c == "\n":
            line = t[start:i].strip()
            hyphen = line[-1:] in ("-", "‐", "¬", "\xad", "")
            if line and not hyphen and not stack and start == first and not out and line[-1] not in _MARKS | _CLOSERS and not re.search(r"[,;:，；：、]", line) and (k := _BLANKS.match(t, i).end()) < n and capital(k):
                out.append(ends[start + len(t[start:i].rstrip()) - 1])
                start = k
                i = start
                continue
            i += 1
            continue
        if _closes(t, i, stack):
            stack.pop()
            i += 1
            continue
        if c in _OPEN and not (c in "“‘" and lang == "de" and not t[i + 1 : i + 2].strip()) and not (c == "’"):
            if c != "‘" or not (i and t[i - 1].isalpha()):
                stack.append((c, i))
            i += 1
            continue
        if c not in _MARKS:
            i += 1
            continue
        j = i + 1
        while j < n and t[j] in _MARKS:
            j += 1
        run = t[i:j]
        depth_before = len(stack)
        k = j
        while k < n and t[k] in _CLOSERS and _closes(t, k, stack):
            opened = stack.pop()
            k += 1
        closed = k > j
        last_opened = opened if closed else None
        at = _NOISE.match(t, k).end()
        i = k
        if at >= n:
            break
        if not _is_end(t, run, j - len(run), j, k, at, lang, periods, start, capital):
            continue
        # inside a bracket or a title nothing ends
        if any(o in _BRACKETS or o in _TITLES for o, _ in stack):
            continue
        if closed:
            before = t[start : last_opened[1]].strip()
            if last_opened[0] in _TITLES:
                continue
            if last_opened[0] in _BRACKETS:
                if before:
                    continue
            elif before and before[-1] not in ":：,，":
                # a quotation inside a sentence: it ends the sentence only where a new one clearly starts
                if lang == "zh" or not capital(at):
                    continue
            if last_opened[0] not in _BRACKETS and not stack:
                if not before and _said_after(t, at, periods):
                    continue
        out.append(ends[k - 1])
        start = at if at <= n else k
        if start > k and t[k:start].strip(" \n\t　"):
            start = _BLANKS.match(t, k).end()
        i = k
    return out


def _is_end(t, run, i, j, k, at, lang, periods, start, capital) -> bool:
    """Does the run of marks t[i:j], with closers up to k, end a sentence, given what comes after?"""
    space = not t[k : k + 1].strip() or "\x80" <= t[k] <= "\x9f"
    if not space and run == "." and t[k].isdigit():
        return False
    if run[0] in "。！？":
        return True
    if lang == "zh":
        if run.startswith("…"):
            return run[-1] in "。！？"
        before = t[i - 1 : i]
        if run == ".":
            return bool(_HAN.match(before) or before in "”」）》" or (before.isdigit() and space)) and not re.match(r"[0-9]", t[j : j + 1]) and bool(capital(at))
        return not before.isascii() or space
    if not capital(at):
        return False
    if run != ".":
        if run.startswith(".") and set(run) == {"."} or run.startswith("…"):
            return not t[at].isdigit()
        return space or t[at].isalpha() or t[at] in "\"'„“‚‘»›("
    word = re.search(r"[^\s\"'„“”‚‘’»«()\[\]—–]+$", t[start:i])
    token = word.group().lower() if word else ""
    if not space and k == j:  # no blank after the period: only a whole word before and a capital behind
        return t[at].isupper() and len(token) > 2 and "." not in token and token.isalpha() and token not in periods.inner
    if not token or k > j:
        return True
    following = _FIRST_WORD.match(t, at)
    after = following.group(1).lower() if following else ""
    if token.isdigit():
        return not (lang == "de" and len(token) <= 2 and after not in periods.starters) and not after.isdigit()
    if len(token) == 1 and token.isalpha() and t[at].isupper():
        return False
    if token in periods.final:
        if (token, after) in periods.collocations and after not in periods.starters:
            return False
        words = [w for w in re.findall(r"[^\W\d_]{2,}", t[start:i])]
        return len(words) >= 2
    return token not in periods.inner and token.rsplit(".", 1)[-1] not in periods.inner


def sentence_ends(df: DataFrame, facts: DataFrame | dict[str, Periods], lang: str = "lang", text: str = "text", out: str = "ends") -> DataFrame:
    """Add ``out`` array<int>: ends of the sentences that another sentence follows in the same text.

    Null, empty and blank texts have none; an unknown or null language is read with the rules of spaces and without
    statistics. Rows are kept as they are, repeated ones too; an existing ``out`` is replaced. The rows are written
    once with a number, by which what is known of their words is joined to them.
    """
    if isinstance(facts, dict):
        facts = facts_of(df.sparkSession, facts)
    clash = "_" * max(map(len, df.columns))
    row, told, form = f"row{clash}", f"told{clash}", f"form{clash}"
    numbered = materialize(df.withColumns({row: F.monotonically_increasing_id(), form: form_of(text)}), "p7-rows")
    tokens = _tokens(numbered.filter(F.length(text) > 0).select(row, F.col(lang).alias("lang"), form), form, row, "lang", where=lambda x: x["t"].rlike(r"[.!?…]"))
    low = lambda c: F.lower(F.regexp_replace(_BARE(F.col(c)), r"\.$", ""))
    # of words stuck together by a missing blank the last one counts, too
    asked = tokens.select(row, "lang", F.explode(F.array(
        F.struct(F.lit("word").alias("as"), low("t").alias("word"), low("n").alias("next")), F.struct(F.lit("word").alias("as"), F.substring_index(low("t"), ".", -1).alias("word"), low("n").alias("next")), F.struct(F.lit("first").alias("as"), low("n").alias("word"), F.lit(None).cast("string").alias("next"))
    )).alias("a")).select(row, "lang", "a.*")
    # words behind a closing quotation, over one period for an abbreviated title, in languages that tell by words who speaks
    speaks = F.broadcast(facts.filter("kind = 'speech'").select("lang").distinct())
    behind = F.regexp_extract_all(F.regexp_replace(form, r"(?<=\p{L})[-‐¬]\s+(?=\p{Ll})", ""), F.lit(_BEHIND), F.lit(1))
    words = F.array_distinct(F.regexp_extract_all(F.array_join(behind, " "), F.lit(r"(?<![\p{L}])\p{Ll}{2,}(?![\p{L}])|[㐀-鿿]{2}(?=[。，.,])"), F.lit(0)))
    said = numbered.filter(F.col(form).rlike(f"[{_CLOSE}]")).select(row, F.col(lang).alias("lang"), form).join(speaks, "lang", "left_semi").select(row, "lang", F.explode(words).alias("word"))
    asked = asked.unionByName(said.select(row, "lang", F.lit("said").alias("as"), "word", F.lit(None).cast("string").alias("next"))).filter("word <> ''").distinct()
    kinds = F.when(F.col("kind").isin("inner", "final", "collocation"), "word").when(F.col("kind") == "starter", "first").otherwise("said")
    known = facts.select("lang", "kind", F.col("word").alias("w"), F.col("next").alias("nx"), kinds.alias("as"))
    found = asked.join(known.withColumnRenamed("w", "word"), ["lang", "as", "word"]).filter(F.col("nx").isNull() | (F.col("nx") == F.col("next")))
    gathered = found.groupBy(row).agg(F.collect_set(F.struct("kind", "word", F.col("nx").alias("next"))).alias(told))

    @F.pandas_udf("array<int>")
    def ends(langs: pd.Series, texts: pd.Series, facts: pd.Series) -> pd.Series:
        return pd.Series([boundaries(t, x or "", periods_of(f)) if t else [] for x, t, f in zip(langs, texts, facts)])

    return numbered.join(gathered, row, "left").withColumn(out, ends(F.col(lang), F.col(text), F.col(told))).select(*[c for c in df.columns if c != out], out)


def sentence_units(df: DataFrame, facts: DataFrame | dict[str, Periods], lang: str = "lang", text: str = "text") -> DataFrame:
    """One row per sentence: the columns of ``df`` with ``sentence`` (its ordinal from 1) and ``sentence_text``.

    Blank texts make no sentence. Texts joined in order, with the blanks between them, are the text again.
    """
    cut = sentence_ends(df, facts, lang, text, "_ends")
    bounds = F.concat(F.array(F.lit(0)), F.col("_ends"), F.array(F.length(text)))
    spans = F.transform(F.sequence(F.lit(1), F.size("_ends") + 1), lambda i: C.strip(F.substring(F.col(text), F.element_at(bounds, i) + 1, F.element_at(bounds, i + 1) - F.element_at(bounds, i))))
    return (
        cut.filter(F.length(C.strip(text)) > 0)
        .select(*df.columns, F.posexplode(spans).alias("_i", "sentence_text"))
        .withColumn("sentence", F.col("_i") + 1)
        .drop("_i")
        .filter("sentence_text <> ''")
    )


def corpus_texts(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct texts of both tables: (rec_table, rec_id, lang, text)."""
    return (
        paragraphs.select(F.lit("paragraph").alias("rec_table"), F.col("paragraph_id").alias("rec_id"), "lang", "text")
        .unionByName(segments.select(F.lit("segment").alias("rec_table"), F.col("id").alias("rec_id"), F.regexp_extract("id", r"^.+?_([a-z]+)_ch\d", 1).alias("lang"), "text"))
        .distinct()
    )
