"""Encoding of a whole corpus with a public tokenizer through a distinct-word table.

Texts are split into the tokenizer's words in the JVM. A word table, built in Spark, holds each distinct word that is
frequent enough once, encoded once; it is broadcast with a proven size bound, and the ids of a text are gathered from
it by position, in Arrow, without shuffling a single occurrence. Words outside the table (each holds less than
``1 / table_size`` of all occurrences) are encoded once per Arrow batch where they stand, so the result is exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: A word enters the table when it makes up more than 1 / TABLE_SIZE of all occurrences: fewer than TABLE_SIZE words.
TABLE_SIZE = 1 << 18
#: Longer words never enter the table, which bounds its bytes.
TABLE_WORD_CHARS = 48
#: Fixed value: the word pattern of the public byte-level tokenizers, with the white space of Unicode spelled out.
_WS = r"\p{IsWhite_Space}"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?![^{_WS}])|{_WS}+"
PYTHON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces of a ``.tiktoken`` vocabulary file with their ids."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


@cache
def load_encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(Path(path).stem, pat_str=PYTHON_PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def encode_word(path: str, word: str) -> list[int]:
    """Ids of one word, which is not split further."""
    return load_encoding(path)._encode_single_piece(word)


def tokenizer_path(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    return str(Path(folder) / name)


def words_of(text):
    """Column with the array of words of ``text``; joined they give the text. Null text gives null, empty text an empty array."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct-word table of a corpus: (word, n) over all texts. Null and empty texts have no words."""
    return df.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encode_table(words: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` to a table of distinct words: each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([encode_word(path, w) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


class WordTable:
    """Encoded words for gathering ids by position: the Arrow form of a broadcast distinct-word table."""

    def __init__(self, words: list[str], ids: list[list[int]], path: str):
        self.path = path
        self.words = pa.array(words, pa.string())
        self.lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.values = np.fromiter((i for x in ids for i in x), np.int32, int(self.lengths.sum()))

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each word, with lengths and values of all rows; words outside the table get rows of their own."""
        at = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(at)
        if not pc.any(missing).as_py():
            return at.to_numpy(zero_copy_only=False).astype(np.int64), self.lengths, self.values
        rare = words.filter(missing)
        new = pc.unique(rare)
        ids = [encode_word(self.path, w) for w in new.to_pylist()]
        rows = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows[missing.to_numpy(zero_copy_only=False)] = len(self.words) + pc.index_in(rare, value_set=new).to_numpy(zero_copy_only=False)
        lengths = np.concatenate([self.lengths, np.fromiter(map(len, ids), np.int64, len(ids))])
        values = np.concatenate([self.values, np.fromiter((i for x in ids for i in x), np.int32)])
        return rows, lengths, values

    def ids_of(self, words: pa.ListArray) -> pa.ListArray:
        """Ids of each text; a null text has none."""
        bounds = list_bounds(words)
        rows, lengths, values = self.lookup(words.flatten())
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        n = lengths[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        gathered = values[np.repeat(starts[rows] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(gathered, pa.int32()))

    def counts_of(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text in the flat words, and the number of ids of each flat word."""
        rows, lengths, _ = self.lookup(words.flatten())
        return list_bounds(words), lengths[rows]


def list_bounds(lists: pa.ListArray) -> np.ndarray:
    """Offsets into ``lists.flatten()``, null lists being empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def build_word_table(df: DataFrame, path: str, text: str = "text", table_size: int = TABLE_SIZE):
    """Broadcast of a :class:`WordTable` of the frequent words of ``df``.

    A word is taken when its count times ``table_size`` exceeds the number of all occurrences, so there are fewer
    than ``table_size`` rows of at most TABLE_WORD_CHARS characters whatever the corpus; counts cover all texts.
    """
    counts = materialize(word_counts(df, text), "word-counts")  # read twice, counted once
    total = counts.agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(total), F.col("n") * table_size > F.col("total")).filter(F.length("word") <= TABLE_WORD_CHARS)
    rows = encode_table(frequent.select("word").coalesce(4), path).collect()
    return df.sparkSession.sparkContext.broadcast(WordTable([r.word for r in rows], [r.ids for r in rows], path))


def encode_corpus(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens.

    Empty and null texts have the empty list; repeated rows come out as often as they stand; extra columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    table = build_word_table(df, path, text, table_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), table.value.ids_of(b.column(1))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), words_of(F.col(text)).alias("_words")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, path: str, *, text: str = "text", out: str = "n_tokens", table_size: int = TABLE_SIZE) -> DataFrame:
    """Replace ``text`` by its number of tokens in ``out``; all other columns stay. Empty and null texts have 0."""
    table = build_word_table(df, path, text, table_size)
    words = "_words" + "_" * max(map(len, df.columns))  # clashes with no column
    keep = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, n = table.value.counts_of(b.column(len(keep)))
            sums = np.concatenate([[0], np.cumsum(n)])[bounds]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.diff(sums), pa.int64())], [*[f.name for f in keep], out])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], f"`{out}` bigint"])
    return df.select(*[F.col(f.name) for f in keep], words_of(F.col(text)).alias(words)).mapInArrow(run, schema)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary as a table (id, piece binary); its size is that of the vocabulary file."""
    ranks = load_ranks(path)
    return spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())}))


def decode_corpus(df: DataFrame, pieces: DataFrame, *, key: str = "doc_id", ids: str = "ids", out: str = "text") -> DataFrame:
    """Texts from ids through the id-to-piece table: (key, out).

    The table (one row per vocabulary entry, at most some hundred thousand) is joined to every id by position inside
    the Arrow batch. Null ids give null, the empty list the empty text; an id that the table lacks is an error.
    """
    rows = pieces.orderBy("id").collect()
    table = df.sparkSession.sparkContext.broadcast(([r.id for r in rows], [bytes(r.piece) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(table.value[0], pa.int32())
        pieces = pa.array(table.value[1], pa.binary())
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(lists.flatten(), value_set=known)
            if at.null_count:
                raise ValueError("an id is not in the vocabulary")
            bounds = pa.array(list_bounds(lists).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, pieces.take(at)), b"")
            texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))], [key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{out}` string")
