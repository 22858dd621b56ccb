"""Phrase collocation mining by marginalising the counts of the longest windows.

Every word begins one window of ``most`` words, the word and its lead columns, padded with the empty word where its piece
of text ends. Only these windows are counted. A phrase of fewer words occurs as often as the windows that begin with it,
so ROLLUP over the windows' counts gives all shorter phrases, the words and the words of a language, and no text is cut
into n-grams of each length.

Tasks count the windows of a bounded number of words before anything is shuffled, so a window that is everywhere is one
entry a task, and send them packed to buckets by a hash of all their words, so none gets all that begin like it. A bucket
adds up what it was sent; its windows that are phrases counted often enough are done, and all windows of the same first
words become one row of the roll-up. Buckets hold a bounded amount; where they are more than ``FAN``, tasks deal to
``FAN`` coarse ones first, whose entries are counted together and dealt again.

Words are compared as bytes. Counts are 64-bit, products of counts decimals of 38 digits: exact up to 10^15 words of a
language. What meets after the roll-up are phrases counted at least ``least`` times: each cut of a candidate looks up its
two parts, and all candidates within a longer one get its count.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each time; equal scores
are ordered by count, then by phrase; an empty table gives no rows. Only lang and text are read. A text of any length is
cut at the marks that end pieces; a piece without one is worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .exchange import bucket_count, text_bytes
from .io import finished, keep, map_batches, table

#: Words of the longest phrase, occurrences of a candidate, phrases that are reported for a language, and the share of a
#: phrase's occurrences, in percent, within one longer candidate that drops it.
MOST, LEAST, TOP, COVERED = 3, 10, 2000, 50
#: Words that a task counts at once, rows of a batch that it sends, text of a bucket on average, and buckets that are dealt to
#: at once at most.
WORDS_AT_ONCE, SEND_ROWS, BUCKET_BYTES, FAN = 1_500_000, 50_000, 12 << 20, 1024
#: Parts of a language from each of which the first phrases are taken before the language's own are.
TOP_PARTS = 64

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False


class _Words:
    """Words of one language in the order of the text, and where pieces end, until they are counted."""

    def __init__(self):
        self.data, self.sizes, self.ends, self.n = [], [], [], 0

    def add(self, buf: np.ndarray, offs: np.ndarray) -> None:
        starts, ends, _ = tk.words(buf, offs, _WORD)
        if not len(starts):
            return
        marks = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_PIECE_END[buf], out=marks[1:])
        doc = np.searchsorted(offs, starts, side="right")
        last = np.ones(len(starts), bool)  # the last word of its piece
        last[:-1] = (marks[starts[1:]] != marks[ends[:-1]]) | (doc[1:] != doc[:-1])
        self.data.append(buf[_WORD[buf]])
        self.sizes.append((ends - starts).astype(np.int64))
        self.ends.append(last)
        self.n += len(starts)

    def counted(self, most: int) -> Counts:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(self.data))])
        coded = words.dictionary_encode()
        last, own = np.concatenate(self.ends), coded.indices.to_numpy(zero_copy_only=False) + np.int32(1)
        leads, open_ = [own], np.ones(len(own), bool)
        for k in range(1, most):
            ahead, ended = np.zeros(len(own), np.int32), np.ones(len(own), bool)
            ahead[:-k], ended[:-k] = own[k:], last[k - 1 : -1]
            open_ = open_ & ~ended
            leads.append(np.where(open_, ahead, np.int32(0)))
        words = pa.concat_arrays([pa.array([b""], pa.large_binary()), coded.dictionary])
        return Counts(words, leads, np.ones(len(own), np.int64)).summed()


def _keys(leads: list[np.ndarray], base: int) -> np.ndarray:
    """A number per row that is the same for the same words."""
    key, room = leads[0].astype(np.uint64), base
    for lead in leads[1:]:
        if room > (1 << 63) // base:  # number the distinct ones anew
            key, room = np.unique(key, return_inverse=True)[1].astype(np.uint64), len(key) + 1
        key, room = key * np.uint64(base) + lead.astype(np.uint64), room * base
    return key


class Counts:
    """Windows as numbers of their words, of which 0 is the empty one that pads, and how often each occurs."""

    def __init__(self, words: pa.Array, leads: list[np.ndarray], n: np.ndarray):
        self.words, self.leads, self.n = words, leads, n

    def summed(self, columns: int | None = None) -> Counts:
        """Equal windows, or those equal in their first ``columns`` words, once with the sum of their counts."""
        leads = self.leads[:columns]
        if not len(self.n):
            return Counts(self.words, leads, self.n)
        key = _keys(leads, len(self.words))
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        del key
        n = np.add.reduceat(self.n[order], head)
        at = order[head]
        return Counts(self.words, [lead[at] for lead in leads], n)

    def where(self, rows: np.ndarray) -> Counts:
        return Counts(self.words, [lead[rows] for lead in self.leads], self.n[rows])

    def hashes(self) -> np.ndarray:
        offsets = np.frombuffer(self.words.buffers()[1], np.int64, len(self.words) + 1)
        data = self.words.buffers()[2]
        own = tk.hash_words(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], offsets[1:])
        h = np.zeros(len(self.n), np.uint64)
        for lead in self.leads:
            h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + own[lead])
        return h

    def packed(self) -> bytes:
        """The windows with only the words that they have, compressed."""
        used = np.zeros(len(self.words), bool)
        used[0] = True
        for lead in self.leads:
            used[lead] = True
        local = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
        columns = [self.words.take(pa.array(np.flatnonzero(used))), *(pa.array(local[lead]) for lead in self.leads), pa.array(self.n)]
        lists = [pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for c in columns]
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays(lists, [str(k) for k in range(len(lists))])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()


def unpacked(bodies: list[bytes]) -> Counts:
    """What several packed windows hold, equal ones once."""
    parts = [[c.values for c in pa.ipc.open_stream(body).read_next_batch().columns] for body in bodies]
    coded = pa.concat_arrays([pa.array([b""], pa.large_binary()), *(p[0] for p in parts)]).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    at, leads = 1, [[] for _ in parts[0][1:-1]]
    for p in parts:
        own = number[at : at + len(p[0])]
        at += len(p[0])
        for to, lead in zip(leads, p[1:-1]):
            to.append(own[lead.to_numpy()])
    return Counts(coded.dictionary, [np.concatenate(x) for x in leads], np.concatenate([p[-1].to_numpy() for p in parts])).summed()


def _columns(most: int) -> list[str]:
    return [f"w{k}" for k in range(1, most + 1)]


_SENT = "lang string, bucket long, body binary"


def _dealt(lang: str, counts: Counts, within: int, fan: int, level: int) -> Iterator[pa.RecordBatch]:
    """A row for each part of bucket ``within`` that the windows fall in, by the digit of their hashes at ``level``."""
    digit = (counts.hashes() // np.uint64(fan**level) % np.uint64(fan)).astype(np.int64)
    order = np.argsort(digit, kind="stable")
    found, begin = np.unique(digit[order], return_index=True)
    for d, a, b in zip(found.tolist(), begin, np.append(begin[1:], len(order))):
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([within * fan + d]), pa.array([counts.where(order[a:b]).packed()], pa.binary())], ["lang", "bucket", "body"])


def _counted_texts(most: int, words_at_once: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Words] = {}
        total = 0
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(code == c)
                texts = batch.column(1) if len(rows) == batch.num_rows else batch.column(1).take(pa.array(rows))
                for _, _, buf, offs in tk.chunks(texts):
                    for piece, own in tk.parts(tk.lower(buf), offs, _PIECE_END):
                        words = open_.setdefault(lang, _Words())
                        before = words.n
                        words.add(piece, own)
                        total += words.n - before
                        while total >= words_at_once:
                            fullest = max(open_, key=lambda x: open_[x].n)
                            done = open_.pop(fullest)
                            total -= done.n
                            yield from _dealt(fullest, done.counted(most), 0, fan, 0)
        for lang, words in open_.items():
            if words.n:
                yield from _dealt(lang, words.counted(most), 0, fan, 0)

    return run


def _dealt_again(words_at_once: int, fan: int, level: int):
    """Rows in order of language and bucket; those of one are counted together up to a bound before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            for lang, bucket, body in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((lang, bucket) != key or size >= 8 * words_at_once):
                    yield from _dealt(key[0], unpacked(held), key[1], fan, level)
                    held, size = [], 0
                key = (lang, bucket)
                held.append(body)
                size += len(body)
        if held:
            yield from _dealt(key[0], unpacked(held), key[1], fan, level)

    return run


def windows(docs: DataFrame, most: int = MOST, words_at_once: int = WORDS_AT_ONCE, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """lang, bucket and body: the longest windows, counted by tasks and packed for the buckets that add them up."""
    buckets = bucket_count(text_bytes(docs), bucket_bytes)
    levels = 1
    while fan**levels < buckets:
        levels += 1
    fan = min(fan, max(8, buckets)) if levels == 1 else fan
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))
    sent = map_batches(text, None, _SENT, whole=_counted_texts(most, words_at_once, fan))
    for level in range(1, levels):  # the rows of one bucket may be many: they are read in turn, not as a group
        dealt = sent.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
        sent = map_batches(dealt, None, _SENT, whole=_dealt_again(words_at_once, fan, level))
    return sent


def _rows(lang: str, counts: Counts, names: list[str]) -> pa.Table:
    """A table in batches of bounded size."""
    words, own = counts.words.cast(pa.large_string()), pa.array([lang], pa.string())
    batches = []
    for a in range(0, max(1, len(counts.n)), SEND_ROWS):
        n = counts.n[a : a + SEND_ROWS]
        columns = [words.take(pa.array(lead[a : a + SEND_ROWS])).cast(pa.string()) for lead in counts.leads]
        batches.append(pa.RecordBatch.from_arrays([own.take(pa.array(np.zeros(len(n), np.int8))), *columns, pa.array(n)], ["lang", *names, "f"]))
    return pa.Table.from_batches(batches)


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, **bounds: int) -> DataFrame:
    """lang, phrase (its words joined by one space; null for all words), size and f of every phrase of up to ``most`` words
    counted ``least`` times or more, and of all words of each language. ``bounds`` are those of :func:`windows`."""
    names = _columns(most)
    sent = windows(docs, most, **bounds).groupBy("lang", "bucket")

    def full_rows(key: tuple, group: pa.Table) -> pa.Table:
        counts = unpacked(group.column("body").to_pylist())
        return _rows(key[0].as_py(), counts.where((counts.leads[-1] > 0) & (counts.n >= least)), names)

    def prefix_rows(key: tuple, group: pa.Table) -> pa.Table:
        return _rows(key[0].as_py(), unpacked(group.column("body").to_pylist()).summed(most - 1), names[:-1])

    schema = lambda own: "lang string, " + ", ".join(f"{c} string" for c in own) + ", f long"
    full = sent.applyInArrow(full_rows, schema(names)).withColumn("size", F.lit(most))
    # from the longest windows down: the phrases that begin them, one word fewer each time, then the language
    prefix = sent.applyInArrow(prefix_rows, schema(names[:-1])).rollup("lang", *names[:-1]).agg(F.sum("f").alias("f"), F.grouping_id().alias("_gid"))
    size = F.lit(most - 1) - F.bit_count("_gid").cast("int")
    shorter = prefix.select("lang", *names[:-1], F.lit(None).cast("string").alias(names[-1]), "f", size.alias("size"))
    ends = F.lit(True)
    for k, c in enumerate(names[:-1], 1):
        ends = ends & ((F.col("size") != k) | (F.col(c) != ""))  # not the windows that end before
    shorter = shorter.where((F.col("size") >= 0) & ends & ((F.col("size") == 0) | (F.col("f") >= least)))
    phrase = F.when(F.col("size") > 0, F.concat_ws(" ", *names))
    return full.unionByName(shorter).select("lang", phrase.alias("phrase"), "size", "f")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, covered: int = COVERED, **bounds: int) -> DataFrame:
    """Each language's first phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score."""
    counts = keep(phrase_counts(docs, most, least, **bounds), "phrases")
    candidates = counts.where("size >= 2")
    word = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(F.col("_w"), a, n), " ")
    named = candidates.withColumn("_w", word)
    # both parts of every cut, looked up by equality
    half = lambda k, side, x: F.struct(k.alias("k"), F.lit(side).alias("side"), x.alias("part"))
    cuts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(half(k, 0, part(F.lit(1), k)), half(k, 1, part(k + 1, F.col("size") - k))))))
    asked = named.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("x")).select("lang", "phrase", "a", "x.k", "x.side", "x.part")
    known = counts.where("size between 1 and " + str(most - 1)).select("lang", F.col("phrase").alias("part"), F.col("f").alias("known"))
    met = asked.join(known, ["lang", "part"])
    one = met.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("known"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("known"))).alias("r"))
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"cast(({wide('a')} * {wide('a')} * {wide('1000000')}) div ({wide('l')} * {wide('r')}) as long)")
    weakest = one.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    scored = weakest.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))
    # the largest count of a longer candidate around each phrase
    inside = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: part(a, n)))
    around = named.where("size > 2").select("lang", F.explode(F.flatten(inside)).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    first = kept.withColumn("_part", salt).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("size = 0 and lang is not null").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished("collocations", lambda: collocations(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, w, i, unnest([1, 2, 3]) AS size FROM spans),
f AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f FROM grams WHERE i + size - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM c),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.w, size, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN (SELECT lang, phrase, f FROM f) x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ')
    JOIN (SELECT lang, phrase, f FROM f) y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:size], ' ')
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
    SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL
),
kept AS (SELECT s.* FROM weakest s LEFT JOIN around o USING (lang, phrase) WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
