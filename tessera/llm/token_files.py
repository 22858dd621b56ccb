"""Token ids in Arrow files: equal-length sequences as fixed-size lists, read back without copying.

Documents are range-partitioned by id and sorted, so partition p's files follow those of partition p - 1. Each task
encodes its documents and writes Arrow IPC files. A file holds whole documents one after the other, cut into sequences
of ``SEQUENCE`` ids; the last sequence is padded. Columns of a file, one row per sequence:

- ``input_ids``: fixed-size list of uint16 (uint32 for vocabularies over 65,536), 0 where padded,
- ``attention_mask``: fixed-size list of bool, false where padded,
- ``starts``: fixed-size list of bool, true at a document's first id,
- ``doc_ids``: list of the ids of the documents that start in the sequence.

The lists of a batch lie in one buffer, so sequence k of a memory-mapped file is a slice. Files are first written under
a task-attempt name and then renamed, so a repeated task leaves one complete file.

Defined cases: a null or empty text has the end id alone; repeated rows each have their place, ordered by a hash of the
text; a null doc_id sorts first; an empty table writes no file. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .io import discard, keep, remove, scratch, ship, table

SEQUENCE = 2048
#: Ids after which a file ends at the next document.
FILE_IDS = 2 << 20
#: Sequences of a record batch.
BATCH_ROWS = 256
#: Pieces of words a worker remembers the ids of; it forgets them all beyond that.
CACHE_WORDS = 100_000
#: Bytes of text encoded at once; the arrays of their ids take some 40 times as much.
CHUNK = 1 << 20
END_ID = 1

MANIFEST_SCHEMA = "file string, n_ids long, n_docs long"


def _piece_classes() -> np.ndarray:
    """1 letters, 2 digits, 3 other visible ASCII, 4 bytes whose word is encoded whole, 0 white space."""
    c = np.full(256, 4, np.uint8)
    c[0x21:0x7F] = 3
    c[0x30:0x3A], c[0x41:0x5B], c[0x61:0x7B] = 2, 1, 1
    c[ord("'")] = 4
    c[~tk.NONSPACE] = 0
    return c


_CLASS = _piece_classes()


#: The parts of a tokenizer's file for which pieces of words can be encoded one by one.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_words(parts: dict) -> bool:
    splits = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (parts.get("normalizer") or {}).get("normalizers") == NORMALIZER and splits[0].get("pattern") == {"Regex": SPLIT} and len(splits) == 2 and splits[1].get("type") == "ByteLevel" and parts["model"].get("end_of_word_suffix") == "</w>"


class WordEncoder:
    """Ids of whole texts, each distinct piece of a word being encoded once.

    For lower-casing word-end BPE tokenizers that drop white space and cut words into runs of letters, single digits and
    runs of other characters. Words of ASCII and Latin-1 letters are cut so; words with an apostrophe or any other
    character are encoded whole. With a tokenizer whose file says anything else, whole texts are encoded.
    """

    _loaded: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.wide = len(vocab) > 1 << 16
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = _by_words(parts)
        self.added = [x["content"].encode() for x in parts["added_tokens"]]
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, starts and ends of the pieces, the first piece of each document, and which are whole words."""
        starts, ends, _ = tk.words(buf, offs, tk.NONSPACE)
        kind = _CLASS[buf]
        low = tk.lower(buf)
        lead = np.flatnonzero(buf == 0xC3)
        lead = lead[lead + 1 < len(buf)]
        tail = buf[lead + 1]
        latin = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[latin], tail[latin]
        kind[lead] = kind[lead + 1] = 1
        low[lead + 1] = np.where(tail <= 0x9E, tail + 0x20, tail)
        raw = buf.tobytes()
        for token in self.added:  # their text counts as the token wherever it stands
            k = raw.find(token)
            while k >= 0:
                kind[k] = 4
                k = raw.find(token, k + 1)
        odd = np.flatnonzero(kind == 4)
        hard = np.zeros(len(starts), bool)
        hard[np.searchsorted(starts, odd, side="right") - 1] = True
        at, to = starts[hard], ends[hard]
        size = to - at
        inside = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kind[inside], low[inside] = 4, buf[inside]
        new = np.empty(len(buf), bool)
        if len(buf):
            new[0] = True
            np.not_equal(kind[1:], kind[:-1], out=new[1:])
            new |= kind == 2
            new &= kind != 0
            new[starts] = True
        begin = np.flatnonzero(new)
        stop = np.minimum(np.append(begin[1:], len(buf)), ends[np.searchsorted(starts, begin, side="right") - 1]) if len(begin) else begin
        return low, begin, stop, np.searchsorted(begin, offs), kind[begin] == 4

    def _learn(self, new: list[bytes], whole: np.ndarray) -> None:
        sizes, flats = [self.size], [self.flat]
        simple = [w for w, x in zip(new, whole) if not x]
        for k in range(0, len(simple), 4096):
            part = simple[k : k + 4096]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) == len(part) and (not len(stops) or stops[-1] == len(ids)):
                sizes.append(np.diff(stops, prepend=0))
                flats.append(ids)
            else:  # a vocabulary without word ends
                each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in each], np.int64))
                flats.append(np.array([i for x in each for i in x], np.uint32))
        rest = [w for w, x in zip(new, whole) if x]
        for k in range(0, len(rest), 4096):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest[k : k + 4096]], add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in each], np.int64))
            flats.append(np.array([i for x in each for i in x], np.uint32))
        self.index.update(zip(simple + rest, range(len(self.size), len(self.size) + len(new))))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(flats)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents with their end ids, and where each document begins (one more entry at the end)."""
        if not self.by_words:
            raw = buf.tobytes()
            each = [e.ids + [END_ID] for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:])], add_special_tokens=False)]
            return np.array([i for x in each for i in x], np.uint32), np.cumsum([0, *map(len, each)])
        low, starts, ends, first, whole = self.pieces(buf, offs)
        _, some, which = np.unique(tk.hash_words(low, starts, ends) ^ whole, return_index=True, return_inverse=True)
        raw = low.tobytes()
        # a whole word is kept apart from a piece with the same bytes by a leading space
        distinct = [(b" " + raw[a:b]) if x else raw[a:b] for a, b, x in zip(starts[some].tolist(), ends[some].tolist(), whole[some].tolist())]
        if len(self.index) > CACHE_WORDS:
            self._forget()
        new = [w for w in distinct if w not in self.index]
        if new:
            self._learn(new, np.array([w[:1] == b" " for w in new]))
        own = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        begin = np.cumsum(self.size) - self.size
        lens, source = self.size[own][which], begin[own][which]
        at = np.zeros(len(offs), np.int64)
        np.cumsum(tk.per_document(lens, first) + 1, out=at[1:])
        out = np.full(int(at[-1]), END_ID, np.uint32)
        place = np.cumsum(lens) - lens
        step = np.arange(int(lens.sum())) - np.repeat(place, lens)
        out[np.repeat(place + tk.owner(first), lens) + step] = self.flat[np.repeat(source, lens) + step]
        return out, at


class SequenceWriter:
    """Writes the files of one partition."""

    def __init__(self, folder: str, partition: int, attempt: int, wide: bool, sequence: int, file_ids: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.name, self.attempt, self.count = f"part-{partition:06d}", attempt, 0
        self.kind, self.length, self.limit = np.uint32 if wide else np.uint16, sequence, file_ids
        self.ids, self.begins, self.docs, self.size = [], [], [], 0

    def add(self, docs: np.ndarray, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """Adds whole documents; yields a manifest row for each file that is full."""
        d = 0
        while d < len(docs):
            e = min(len(docs), max(d + 1, int(np.searchsorted(at, at[d] + self.limit - self.size, side="left"))))
            self.ids.append(ids[at[d] : at[e]].astype(self.kind))
            self.begins.append(at[d:e] - at[d] + self.size)
            self.docs.append(docs[d:e])
            self.size += int(at[e] - at[d])
            d = e
            if self.size >= self.limit:
                yield self.close()

    def close(self) -> tuple[str, int, int]:
        n, length = self.size, self.length
        rows = -(-n // length)
        ids = np.zeros(rows * length, self.kind)
        ids[:n] = np.concatenate(self.ids)
        begin, docs = np.concatenate(self.begins), np.concatenate(self.docs)
        mask, starts = np.arange(rows * length) < n, np.zeros(rows * length, bool)
        starts[begin] = True
        first = np.searchsorted(begin, np.arange(rows + 1) * length)
        name = f"{self.name}-{self.count:05d}.arrow"
        temporary = f"{self.base}/.{name}.{self.attempt}"
        lists = lambda values: pa.FixedSizeListArray.from_arrays(pa.array(values), length)
        whole = pa.record_batch([lists(ids), lists(mask), lists(starts), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(docs))], ["input_ids", "attention_mask", "starts", "doc_ids"])
        with self.fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, whole.schema) as writer:
            for k in range(0, rows, BATCH_ROWS):
                writer.write_batch(whole.slice(k, BATCH_ROWS))
        self.fs.move(temporary, f"{self.base}/{name}")
        out = (name, n, len(docs))
        self.ids, self.begins, self.docs, self.size, self.count = [], [], [], 0, self.count + 1
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, sequence: int = SEQUENCE, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes and writes ``docs`` in ascending doc_id order; the manifest has a row per file. The text is shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordEncoder.of(tokenizer), TaskContext.get()
        writer = SequenceWriter(folder, task.partitionId(), task.taskAttemptId(), encoder.wide, sequence, file_ids)
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in tk.chunks(batch.column(1), CHUNK):
                done += writer.add(ids[i:j], *encoder.encode(buf, offs))
        if writer.size:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["file", "n_ids", "n_docs"])

    ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return keep(ordered.mapInArrow(run, MANIFEST_SCHEMA), "manifest")


def _documents(content: bytes) -> pa.RecordBatch:
    reader = pa.ipc.open_file(pa.BufferReader(content))
    parts = [reader.get_batch(k) for k in range(reader.num_record_batches)]
    flat = lambda name: np.concatenate([p.column(name).flatten().to_numpy(zero_copy_only=False) for p in parts])
    ids, n = flat("input_ids"), int(flat("attention_mask").sum())
    begin = np.flatnonzero(flat("starts"))
    docs = np.concatenate([p.column("doc_ids").flatten().to_numpy() for p in parts])
    at = np.append(begin, n)
    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
    doc_id = pa.array(docs, mask=docs == np.iinfo(np.int64).min)
    return pa.RecordBatch.from_arrays([doc_id, pa.array(begin), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "offset", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids_crc32 of every document, from the files themselves.

    Each file's place is the running total of the manifest, a row per file of some 2 million ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = _documents(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([path] * got.num_rows), *got.columns], ["file", *got.schema.names])

    base = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder) if not manifest.isEmpty() else None
    schema = "file string, doc_id long, offset long, n_tokens long, ids_crc32 long"
    if files is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    got = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)
    return got.join(base, "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per document from token files that are written, read back and then deleted."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, tokenizer or tokenizer_path())
    out = keep(read_token_files(spark, folder, manifest), "documents")
    remove(spark, folder)
    discard(manifest)
    return out


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
