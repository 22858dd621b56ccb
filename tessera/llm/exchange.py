"""Packed exchanges: chunks of documents ask buckets of names about all other chunks, and get bits back.

A chunk sends a row per bucket with what it asks, packed, and a row for itself with the bucket of each thing it has. A
bucket answers with a bit for each thing asked, in the same order, and the chunk's own row and its answers meet again.
A name that a chunk holds often is sent once, so one that is everywhere costs a bucket an entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .io import keep, map_batches, remove, scratch

#: Names are cut to so many bytes; a chance match makes a name seem seen twice.
NAME_BYTES = 5
#: Text of a bucket, on average.
BUCKET_BYTES = 16 << 20

SENT = "bucket int, chunk long, head int, body binary, who binary, docs binary"
U64 = np.uint64


def chunk_id(k: int) -> int:
    return (TaskContext.get().partitionId() << 32) | k


def code_type(buckets: int) -> np.dtype:
    return np.dtype(np.uint8 if buckets < 1 << 8 else np.uint16 if buckets < 1 << 16 else np.uint32)


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each name, from bits that :func:`pack` cuts off."""
    return ((name & U64(0xFFFFFF)) % U64(buckets)).astype(np.int64)


def pack(names: np.ndarray, width: int = NAME_BYTES) -> bytes:
    """The highest ``width`` bytes of each name."""
    return np.ascontiguousarray((names >> U64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes, width: int = NAME_BYTES) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def name_rows(name: np.ndarray, buckets: int, chunk: int) -> tuple[list[tuple], bytes]:
    """What a chunk sends to ask which of its names are seen twice: a row per bucket, and for its own row the bucket of each
    name. Names that the chunk itself holds twice need no answer and are sent once, for the others."""
    u, back, count = np.unique(name, return_inverse=True, return_counts=True)
    code = np.where(count[back] == 1, bucket_of(name, buckets), buckets) if len(u) else np.zeros(0, np.int64)
    order, begin = split(code, buckets)
    more = u[count > 1]
    more_order, more_begin = split(bucket_of(more, buckets), buckets)
    rows = []
    for b in np.flatnonzero(np.diff(begin) + np.diff(more_begin)).tolist():
        own, other = name[order[begin[b] : begin[b + 1]]], more[more_order[more_begin[b] : more_begin[b + 1]]]
        rows.append((b, chunk, len(own), pack(np.concatenate([own, other])), None, None))
    return rows, code.astype(code_type(buckets)).tobytes()


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "chunk", "head", "body", "who", "docs"])


def split(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by bucket, in their own order within one, and where each bucket begins."""
    order = np.argsort(code, kind="stable")
    return order, np.searchsorted(code[order], np.arange(buckets + 1))


def named_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which rows have one."""
    ids = batch.column(0)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ~ids.is_null().to_numpy(zero_copy_only=False)


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def bucket_count(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(8, -(-size // bucket_bytes))


def exchange(sent: DataFrame, answer: Callable, gather_: Callable, schema: str, what: str, compression: str | None = None) -> DataFrame:
    """Writes what is sent, by the session's compression or another, lets the buckets answer, and puts the answers of each chunk
    together."""
    spark = sent.sparkSession
    path = scratch(spark, what)
    (sent.write.option("compression", compression) if compression else sent.write).parquet(path)
    stored = spark.read.schema(SENT).parquet(path)
    answers = stored.where("bucket >= 0").groupBy("bucket").applyInArrow(answer, SENT)
    out = keep(answers.unionByName(stored.where("bucket < 0")).groupBy("chunk").applyInArrow(gather_, schema), what)
    remove(spark, path)
    return out


def seen_twice(text: DataFrame, names_of: Callable, buckets: int, chunk_bytes: int, what: str, compression: str | None = None) -> DataFrame:
    """doc_id, mark, n and bits: for each document's names, in their order, whether any place holds the name again.

    ``text`` has doc_id, text and mark (a hash of the text). ``names_of(buf, offs)`` gives the names, each one's document, and
    which documents take part; it must give a document the same names in any chunk. Rows without an id take no part."""
    sent = map_batches(text, None, SENT, whole=_send_names(buckets, names_of, chunk_bytes))
    flags = exchange(sent, answer_seen, _name_flags(buckets), FLAGS, what, compression)
    return flags.dropDuplicates(["doc_id", "mark"])  # repeated rows have equal names; the flags of one are enough


def _send_names(buckets: int, names_of: Callable, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, named = named_rows(batch)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in tk.chunks(batch.column(1), chunk_bytes):
                name, doc, ok = names_of(buf, offs)
                ok = ok & named[i:j]
                some = ok[doc]
                name, doc = name[some], doc[some]
                if not len(name):
                    continue
                chunk, number = chunk_id(number), number + 1
                rows, code = name_rows(name, buckets, chunk)
                per = np.bincount(doc, minlength=j - i)[ok]
                docs = np.stack([ids[i:j][ok], marks[i:j][ok], per]).astype(np.int64)
                yield batch_of([*rows, (-1, chunk, len(per), code, None, docs.tobytes())])

    return run


def answer_seen(group: pa.Table) -> pa.Table:
    parts = [unpack(x.as_py()) for x in group.column("body")]
    _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return answers_of(group, count[back] > 1, [len(p) for p in parts])


def answers_of(group: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    begin = np.cumsum([0, *sizes])
    heads = group.column("head").to_pylist()
    bits = [np.packbits(flags[a : a + h]).tobytes() for a, h in zip(begin, heads)]
    n = len(bits)
    return pa.table([group.column("bucket"), group.column("chunk"), group.column("head"), pa.array(bits, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["bucket", "chunk", "head", "body", "who", "docs"])


def gather(group: pa.Table, buckets: int, fields: int = 3) -> tuple[np.ndarray, np.ndarray, dict]:
    """The flags of a chunk in its own order, from the answers of the buckets; those settled by the chunk are true."""
    rows = {r["bucket"]: r for r in group.to_pylist()}
    frame = rows[-1]
    code = np.frombuffer(frame["body"], code_type(buckets)).astype(np.int64)
    flags = np.ones(len(code), bool)
    order, begin = split(code, buckets)
    for b, r in rows.items():
        if b >= 0:
            flags[order[begin[b] : begin[b + 1]]] = np.unpackbits(np.frombuffer(r["body"], np.uint8), count=r["head"]).astype(bool)
    return flags, np.frombuffer(frame["docs"], np.int64).reshape(fields, -1), frame


FLAGS = "doc_id long, mark long, n int, bits binary"


def _name_flags(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        flags, docs, _ = gather(group, buckets)
        at = np.cumsum(docs[2]) - docs[2]
        bits = [np.packbits(flags[a : a + n]).tobytes() for a, n in zip(at, docs[2])]
        return pa.table([pa.array(docs[0]), pa.array(docs[1]), pa.array(docs[2].astype(np.int32)), pa.array(bits, pa.binary())], names=["doc_id", "mark", "n", "bits"])

    return run
