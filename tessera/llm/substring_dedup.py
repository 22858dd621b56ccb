"""Substring dedup: words in windows that begin in an earlier document too are removed, found by recompression.

1. Every task names the runs and pairs of its documents' words by recompression (three rounds of pairs). Each name goes
   once per chunk of text to the bucket of its hash, which answers with one bit: is it seen twice or more? Equal windows
   hold the same inner symbols, so a window with an inner symbol of its own occurs once and needs no more work.
2. The windows that are left send their hash once per chunk and document to buckets again, which answer whether a
   document with a smaller id has the same. Windows covered by the answer yes are removed.
3. The removed words' ranges meet the texts again.

What is sent is packed: a row per chunk and bucket, with the answers as bits in the same order, so that most of the
exchange is a few bytes per symbol. A symbol or window that is everywhere is sent once by a chunk. Buckets grow with the
text. Answers are put together per chunk, and texts are joined to their document's flags and ranges by id and hash.

Names are cut to 40 bits for step 1, where a chance match only keeps a window for step 2. Step 2 compares windows by two
64-bit hashes, made of two independent hashes of each word.

Defined cases: a null or empty text has no words, and the digest of the empty string; a document shorter than a window
keeps all; repeated rows with one id do not remove each other's words, as neither id is smaller; rows with a null id
are kept whole and remove nothing; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .exchange import BUCKET_BYTES, SENT, answers_of, batch_of, bucket_count, chunk_id, code_type, exchange, gather, named_rows, seen_twice, split, text_bytes
from .io import map_batches, table
from .recompress import recompress

WINDOW, ROUNDS = 13, 3
#: Bytes of text of a chunk; the arrays of the rounds take some 25 times as much.
CHUNK = 3 << 20
#: How what is sent is stored; disk is what bounds this query.
COMPRESSION = "zstd"


def _names(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tk.words(buf, offs, tk.NONSPACE)
    s = recompress(tk.hash_words(buf, starts, ends), tk.owner(first), ROUNDS)
    return s.name, s.doc, np.diff(first) >= WINDOW


def _candidates(h: np.ndarray, first: np.ndarray, bits: list, sizes: list) -> np.ndarray:
    """Starts of the windows whose inner symbols are all seen twice or more."""
    s = recompress(h, tk.owner(first), ROUNDS)
    per = np.bincount(s.doc, minlength=len(first) - 1)
    begin = np.cumsum(per) - per
    seen = np.zeros(len(s.name) + 1, np.int64)
    for d, (b, n) in enumerate(zip(bits, sizes)):
        if b is not None:
            if n != per[d]:
                raise ValueError("a document has other symbols than when it was asked about")
            seen[begin[d] + 1 : begin[d] + 1 + n] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
    own = np.concatenate([[0], np.cumsum(1 - seen[1:])])
    at = tk.within(first, WINDOW)
    low = np.searchsorted(s.low, at)
    high = np.maximum(low, np.searchsorted(s.high, at + WINDOW, side="right"))
    has = np.array([b is not None for b in bits], bool)
    at_doc = np.searchsorted(first, at, side="right") - 1
    return at[(own[high] == own[low]) & has[at_doc]]


def _send_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, _ = named_rows(batch)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            bits, sizes = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            for i, j, buf, offs in tk.chunks(batch.column(1), CHUNK):
                if all(b is None for b in bits[i:j]):
                    continue
                starts, ends, first = tk.words(buf, offs, tk.NONSPACE)
                h = tk.hash_words(buf, starts, ends)
                at = _candidates(h, first, bits[i:j], sizes[i:j])
                if not len(at):
                    continue
                keys = [tk.window_hash(x, WINDOW)[at] for x in (h, tk.hash_words(buf, starts, ends, seed=1))]
                doc = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((ids[i:j][doc], *keys[::-1]))
                new = np.ones(len(order), bool)
                new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
                least = ids[i:j][doc[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]
                later = np.zeros(len(at), bool)
                later[order] = ids[i:j][doc[order]] > least  # an earlier document of this very chunk has it
                code = np.where(later, buckets, ((keys[0] & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64))
                order, begin = split(code, buckets)
                has = np.unique(doc)
                local = np.searchsorted(has, doc)
                small = np.uint16 if len(has) < 1 << 16 else np.uint32
                per = np.bincount(local, minlength=len(has))
                docs = np.stack([ids[i:j][has], marks[i:j][has], per]).astype(np.int64).tobytes()
                chunk, number, rows = chunk_id(number), number + 1, []
                for b in np.flatnonzero(np.diff(begin)).tolist():
                    own = order[begin[b] : begin[b + 1]]
                    used, who = np.unique(local[own], return_inverse=True)
                    body = np.stack([k[own] for k in keys]).tobytes()
                    rows.append((b, chunk, len(own), body, who.astype(small).tobytes(), ids[i:j][has[used]].astype(np.int64).tobytes()))
                steps = np.diff(at - first[doc], prepend=0).astype(np.int32)
                rows.append((-1, chunk, len(at), code.astype(code_type(buckets)).tobytes(), steps.tobytes(), docs))
                yield batch_of(rows)

    return run


def _answer_windows(group: pa.Table) -> pa.Table:
    keys, docs, sizes = [], [], []
    for r in group.select(["head", "body", "who", "docs"]).to_pylist():
        keys.append(np.frombuffer(r["body"], np.uint64).reshape(2, -1))
        own = np.frombuffer(r["docs"], np.int64)
        who = np.frombuffer(r["who"], np.uint16 if len(r["who"]) == 2 * r["head"] else np.uint32)
        docs.append(own[who])
        sizes.append(r["head"])
    key, doc = np.concatenate(keys, axis=1), np.concatenate(docs)
    order = np.lexsort((doc, *key[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any(key[:, order[1:]] != key[:, order[:-1]], axis=0)
    flags = np.zeros(len(order), bool)
    flags[order] = doc[order] > doc[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return answers_of(group, flags, sizes)


RANGES = "doc_id long, mark long, ranges binary"


def _removed_ranges(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        flags, docs, frame = gather(group, buckets)
        place = np.cumsum(np.frombuffer(frame["who"], np.int32).astype(np.int64))
        begin = np.cumsum(docs[2]) - docs[2]
        out = []
        for k in range(docs.shape[1]):
            own = place[begin[k] : begin[k] + docs[2, k]][flags[begin[k] : begin[k] + docs[2, k]]]
            if len(own):
                cut = np.flatnonzero(np.diff(own) > WINDOW)
                spans = np.stack([own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)] + WINDOW], axis=1)
                out.append((int(docs[0, k]), int(docs[1, k]), spans.astype(np.int32).tobytes()))
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["doc_id", "mark", "ranges"])

    return run


def removed_ranges(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, a hash of the text, and the removed word ranges (pairs of int32) of the documents that lose words."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    buckets = bucket_count(text_bytes(docs), bucket_bytes)
    flags = seen_twice(text, _names, buckets, CHUNK, "names", COMPRESSION)
    flagged = text.join(flags, ["doc_id", "mark"]).select("doc_id", "text", "mark", "n", "bits")
    sent = map_batches(flagged, None, SENT, whole=_send_windows(buckets))
    ranges = exchange(sent, _answer_windows, _removed_ranges(buckets), RANGES, "windows", COMPRESSION)
    return ranges.dropDuplicates(["doc_id", "mark"])


def _digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n_words, n_removed, digests = [], [], []
    for text, ranges in zip(batch.column(1), batch.column(2)):
        words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
        n_words.append(len(words))
        if ranges.is_valid:
            stay = np.ones(len(words), bool)
            for a, b in np.frombuffer(ranges.as_py(), np.int32).reshape(-1, 2):
                stay[a:b] = False
            words = list(compress(words, stay.tolist()))
        n_removed.append(n_words[-1] - len(words))
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text and the removed word ranges (null: none) of every document."""
    ranges = removed_ranges(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return text.join(ranges, ["doc_id", "mark"], "left").select("doc_id", "text", "ranges")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_batches(dedup(table(spark, sf_dir, "documents")), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS k FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT x.doc_id, unnest(range(i, i + 13)) AS pos FROM x JOIN m USING (k) WHERE x.doc_id > m.least) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(len(gone), 0) AS bigint) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
