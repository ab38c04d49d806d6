"""Encoding a corpus with a public tokenizer, each distinct word once.

Texts are split into pre-tokens by the tokenizer's pattern, in the JVM. The distinct pre-tokens of the corpus are counted
with a map-side aggregation, and each is encoded once. Ids come back in two ways. The most frequent words, which make up most of
the text, are a broadcast table bounded in words and bytes; their ids are put in place within the document's row. All others
leave the row with the place they belong to, meet their ids by a shuffle join on the word, and are put in between. A word too
long for the broadcast may still be in every document: the join spreads the rows of hot words over many tasks.

Defined results: a null and an empty text both give an empty list; strings of special tokens in a text are ordinary text;
copies are encoded like any other text; other columns are ignored. Decoding is the inverse: ids joined with the table of
token bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.skew import hot_buckets, salted_join
from sievelight.session import materialise

#: Words broadcast, and bytes of all of them together, at most.
FREQUENT, FREQUENT_BYTES = 50_000, 4 << 20

#: Fixed value: the pattern that the byte-level vocabularies are split by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(folder: str | None = None, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """Ranks by token bytes, of a file in the folder of public tokenizers (SIEVELIGHT_TOKENIZERS, else /opt/tokenizers)."""
    folder = folder or os.environ.get("SIEVELIGHT_TOKENIZERS", "/opt/tokenizers")
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pretokens(text):
    """array<string> of the pre-tokens of a text, in order; they concatenate to the text."""
    # (?U) gives \s its Unicode meaning
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, n, ids) of (word, n); the vocabulary, of fixed size, is broadcast."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = None
        for batch in batches:
            coder = coder or tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
            one = coder._core_bpe.encode_single_piece
            ids = pa.array([one(w.encode()) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, ids array<int>")


def frequent_words(coded: DataFrame) -> pa.Table:
    """(word, ids) of the most frequent words: at most FREQUENT, and no more than fit into FREQUENT_BYTES, shorter ones first among equals."""
    rows = coded.where(F.octet_length("word") * 16 <= FREQUENT_BYTES).orderBy(F.desc("n"), F.octet_length("word"), "word").limit(FREQUENT).select("word", "ids").toArrow()
    size = np.cumsum(pc.binary_length(rows["word"]).to_numpy() + 4 * pc.list_value_length(rows["ids"]).to_numpy())
    return rows.slice(0, int(np.searchsorted(size, FREQUENT_BYTES, side="right")))


PARTS = "_id {}, ids array<int>, rest array<struct<at:int,word:string>>"


def _in_place(split: DataFrame, frequent: pa.Table) -> DataFrame:
    """(_id, ids, rest): the ids of the frequent words of each document, and its other words with the number of those ids before them."""
    spark = split.sparkSession
    shared = spark.sparkContext.broadcast((frequent["word"].combine_chunks().cast(pa.large_string()), frequent["ids"].combine_chunks()))
    kind = dict(split.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        sizes = np.r_[np.asarray(pc.list_value_length(ids)), 0].astype(np.int64)  # the last is that of an unknown word
        starts, flat = np.r_[np.asarray(ids.offsets)[:-1], 0].astype(np.int64), np.asarray(ids.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            words = lists.flatten()
            places = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists)))]
            which = pc.index_in(words.cast(pa.large_string()), value_set=known)
            which = which.fill_null(len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = sizes[which]
            ends = np.r_[0, np.cumsum(n)]
            taken = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[which], n)
            rare = np.flatnonzero(which == len(known))
            doc = np.searchsorted(places, rare, side="right") - 1
            at = ends[rare] - ends[places[doc]]
            cuts = np.searchsorted(rare, places)
            rest = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), words.take(pa.array(rare)).cast(pa.string())], names=["at", "word"])
            out = pa.ListArray.from_arrays(pa.array(ends[places].astype(np.int32)), pa.array(flat[taken], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rest)], names=["_id", "ids", "rest"])

    return split.mapInArrow(run, PARTS.format(kind))


def encode(documents: DataFrame, ident: str = "doc_id", text: str = "text", folder: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """(ident, ids array<int>), one row per row of ``documents``; ``ident`` is unique."""
    split = materialise(documents.select(F.col(ident).alias("_id"), pretokens(F.coalesce(F.col(text), F.lit(""))).alias("_words")), "split")
    counted = split.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    coded = materialise(encode_words(counted, vocabulary(folder, name)), "words")
    frequent = frequent_words(coded)
    parts = materialise(_in_place(split, frequent), "parts")
    # each rare word of a document, in order, with how many ids of frequent words stand before it
    placed = parts.where(F.size("rest") > 0).select("_id", F.posexplode("rest").alias("i", "r")).select("_id", "i", "r.at", "r.word")
    hot = hot_buckets(placed, ["word"], coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = salted_join(placed, coded.select("word", F.col("ids").alias("more")), ["word"], hot)
    whole = met.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("i", "at", "more"))).alias("rare"))
    before = lambda r, k: F.slice("ids", F.when(k == 0, F.lit(1)).otherwise(F.get("rare", k - 1)["at"] + 1), r["at"] - F.when(k == 0, F.lit(0)).otherwise(F.get("rare", k - 1)["at"]))
    last = F.element_at("rare", -1)["at"]
    between = F.flatten(F.transform("rare", lambda r, k: F.concat(before(r, k), r["more"])))
    full = F.concat(between, F.slice("ids", last + 1, F.size("ids") - last))
    mixed = parts.where(F.size("rest") > 0).select("_id", "ids").join(whole, "_id").select("_id", full.alias("ids"))
    return parts.where(F.size("rest") == 0).select("_id", "ids").unionByName(mixed).select(F.col("_id").alias(ident), "ids")


def decode(encoded: DataFrame, ident: str = "doc_id", folder: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """(ident, text): the texts that lists of ids stand for; an empty list gives an empty text, an unknown id null."""
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for b, i in vocabulary(folder, name).items()], "id int, bytes binary")  # fixed size
    exploded = encoded.select(F.col(ident).alias("_id"), F.posexplode("ids").alias("at", "id"))
    pieces = exploded.join(F.broadcast(table), "id", "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("h")))).alias("p"))
    joined = F.when(F.exists("p", lambda x: x["h"].isNull()), None).otherwise(F.decode(F.unhex(F.array_join("p.h", "")), "UTF-8"))
    texts = pieces.select("_id", F.struct(joined.alias("text")).alias("t"))
    return encoded.select(F.col(ident).alias("_id")).join(texts, "_id", "left").select(F.col("_id").alias(ident), F.when(F.col("t").isNull(), F.lit("")).otherwise(F.col("t.text")).alias("text"))
