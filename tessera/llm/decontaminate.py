"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded run of documents in one task. Its words become symbols of the benchmark's vocabulary; words that
no benchmark phrase holds break the sequence, and pieces shorter than the shortest phrase cannot hold one. Backward
search finds every phrase in the index, sampled suffix positions locate the occurrences, and overlapping spans merge.

The benchmark is read in blocks of bounded size, so a large one takes several passes and never grows a task. The answers of
all passes meet by id and a hash of the text, so rows that share only an id, or have none, are told apart.

Defined cases: a null or empty text has no words and is clean; a null or empty benchmark item has no phrase; the words of
an item without an id are hit, but it is not listed or counted; an empty benchmark leaves every document clean; repeated
documents are judged alike and repeated items count once by id. Words are compared by 64-bit hashes. Only doc_id, text and
item_id, text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .fmindex import FMIndex
from .io import fresh, keep, map_batches, table

WINDOW = 13
#: Text of the benchmark that one pass searches for.
BLOCK_BYTES = 4 << 20
#: Text of a shard, the documents of one index.
SHARD_BYTES = 4 << 20

HITS_SCHEMA = "doc_id long, mark long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"


class Phrases:
    """The distinct windows of a block of items, as rows of symbols from 1, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]]):
        col = pa.array([t for _, t in items], pa.string())
        names: dict[str | None, int] = {}
        known, sizes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for i, _, buf, offs in tk.chunks(col):
            buf = tk.lower(buf)
            starts, ends, first = tk.words(buf, offs, tk.ALNUM)
            h = tk.hash_words(buf, starts, ends)
            known.append(np.unique(h))
            n = np.diff(first)
            count = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
            item = np.repeat(np.arange(len(n)), count)
            begin = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][item]
            size = np.minimum(n, WINDOW)[item]
            at = begin[:, None] + np.arange(WINDOW)
            words = np.where(np.arange(WINDOW) < size[:, None], h[np.minimum(at, max(len(h) - 1, 0))], 0) if len(item) else np.zeros((0, WINDOW), np.uint64)
            parts.append((words, size))
            sizes.append(size)
            owners.append(np.array([names.setdefault(items[i + d][0], len(names)) for d in range(len(n))], np.int64)[item])
        self.items = list(names)
        self.vocab = np.unique(np.concatenate(known))
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(self.vocab >> np.uint64(48)).astype(np.int64)] = True
        lengths, owner = np.concatenate(sizes), np.concatenate(owners)
        rows = np.concatenate([np.where(np.arange(WINDOW) < z[:, None], np.searchsorted(self.vocab, w) + 1, 0).astype(np.int32) for w, z in parts]) if parts else np.zeros((0, WINDOW), np.int32)
        self.rows, back = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        back = back.reshape(-1)
        self.lengths = np.zeros(len(self.rows), np.int64)
        self.lengths[back] = lengths
        pairs = np.unique(np.stack([back, owner], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.owners = pairs[:, 1]
        self.shortest = int(self.lengths.min()) if len(self.rows) else 0

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word; 0 for words of no phrase."""
        out = np.zeros(len(h), np.int64)
        if len(self.vocab):
            some = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocab, h[some]), len(self.vocab) - 1)
            same = self.vocab[place] == h[some]
            out[some[same]] = place[same] + 1
        return out


def _pieces(symbols: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The text to index and each symbol's word: pieces of known words in one document, long enough, each after a break."""
    known = symbols > 0
    start = known.copy()
    start[1:] &= ~known[:-1]
    edge = first[:-1][first[:-1] < len(symbols)]
    start[edge] = known[edge]
    begin = np.flatnonzero(start)
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    edge = first[1:][first[1:] > 0] - 1
    stop[edge] = known[edge]
    end = np.flatnonzero(stop) + 1
    long = end - begin >= shortest
    begin, end = begin[long], end[long]
    size = end - begin + 1  # a break before each
    word = np.repeat(begin - 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text = symbols[np.maximum(word, 0)]
    text[np.concatenate([[0], np.cumsum(size)[:-1]])[: len(size)]] = 0
    return text, word


def _searcher(phrases: Phrases, rows: bool = False):
    """Searches batches of doc_id, text and mark, or, with ``rows``, of whole rows in one column, which are carried along."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        carried, texts = ([batch.column(0)], batch.column(0).field("text")) if rows else ([batch.column(0), batch.column(2)], batch.column(1))
        for i, j, buf, offs in tk.chunks(texts, SHARD_BYTES):
            buf = tk.lower(buf)
            starts, ends, first = tk.words(buf, offs, tk.ALNUM)
            spans: list[list[dict]] = [[] for _ in range(j - i)]
            items: list[list[str]] = [[] for _ in range(j - i)]
            if len(phrases.rows) and len(starts):
                text, word = _pieces(phrases.symbols(tk.hash_words(buf, starts, ends)), first, phrases.shortest)
                if len(text):
                    _hits(phrases, text, word, first, spans, items)
            yield pa.RecordBatch.from_arrays([*(x.slice(i, j - i) for x in carried), pa.array(np.diff(first).astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], [*(["row"] if rows else ["doc_id", "mark"]), "n_words", "spans", "items"])

    return work


def _hits(phrases: Phrases, text: np.ndarray, word: np.ndarray, first: np.ndarray, spans: list, items: list) -> None:
    index = FMIndex(text, len(phrases.vocab))
    low, high = index.search(phrases.rows, phrases.lengths)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = word[index.locate(rows)]
    n = int(first[-1])
    hit = np.zeros(n + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + phrases.lengths[which], -1)
    hit = np.cumsum(hit[:-1]) > 0
    doc = np.searchsorted(first, at, side="right") - 1
    of = np.repeat(doc, phrases.first[which + 1] - phrases.first[which])
    size = phrases.first[which + 1] - phrases.first[which]
    item = phrases.owners[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(phrases.first[which], size)]
    for d, k in np.unique(np.stack([of, item], axis=1), axis=0):
        if phrases.items[k] is not None:
            items[d].append(phrases.items[k])
    for d in np.unique(doc):
        flags = np.concatenate([[False], hit[first[d] : first[d + 1]], [False]]).astype(np.int8)
        turn = np.flatnonzero(np.diff(flags))
        spans[d] = [{"first": int(a), "last": int(b)} for a, b in zip(turn[::2], turn[1::2])]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    bench = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bench, max(1, -(-int(total) // block_bytes))


def _phrases(bench: DataFrame) -> Phrases:
    return Phrases([(r.item_id, r.text) for r in bench.toLocalIterator()])


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated; no shuffle if the benchmark is one block."""
    bench, blocks = _blocks(benchmark, block_bytes)
    if blocks > 1:
        id_, mark, bad_mark = (fresh(x, docs.columns) for x in ("id", "mark", "bad_mark"))
        bad = contamination(find_phrases(docs, benchmark, block_bytes)).where("contaminated").select(F.col("doc_id").alias(id_), F.col("mark").alias(bad_mark)).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(bad_mark))
        return docs.withColumn(mark, F.xxhash64("text")).join(bad, same, "left_anti").select(docs.columns)
    hits = T.StructType.fromDDL(HITS_SCHEMA.split(", ", 2)[2])
    schema = T.StructType([T.StructField("row", docs.schema), *hits.fields])
    found = map_batches(docs.select(F.struct("*").alias("row")), _searcher(_phrases(bench), rows=True), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"]))
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("row.*")


def find_phrases(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, a hash of the text (mark), n_words, merged spans of hit words (end exclusive) and ids of occurring items, one row
    per document row. ``block_bytes`` bounds the benchmark text that a pass sends to the tasks."""
    bench, blocks = _blocks(benchmark, block_bytes)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    found = None
    for b in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        part = map_batches(text, _searcher(_phrases(own)), HITS_SCHEMA)
        if blocks > 1:
            part = keep(part.withColumn("block", F.lit(b)), "decontaminate")
        found = part if found is None else found.unionByName(part)
    return found if blocks == 1 else _merge(found, blocks)


def _merge(found: DataFrame, blocks: int) -> DataFrame:
    """Of several passes: each document's spans merge in one fold. Rows that repeat an id and a text had equal answers, so one
    of each pass is enough, and each of the rows gets the merged one."""
    runs = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(done, F.array(x))),
    )
    once = found.groupBy("doc_id", "mark", "n_words", "block").agg(F.count(F.lit(1)).alias("n"), F.any_value("spans").alias("spans"), F.any_value("items").alias("items"))
    grouped = once.groupBy("doc_id", "mark", "n_words").agg(F.max("n").alias("n"), runs.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return grouped.select("doc_id", "mark", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_copy")).drop("_copy")


def contamination(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"]))
    out = hits.select("doc_id", "mark", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS phrase, least(len(w), 13) AS n FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM d, s, unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM x JOIN p ON x.phrase = p.phrase AND x.n = p.n),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
