"""N-gram Jaccard join in the metric space of shingle sets: exact links, their classes and their numbers.

The Jaccard distance d = 1 - J obeys the triangle inequality, and two documents link when d is at most a radius r. Nearly all
documents of a corpus are at distance almost 1 from each other, so cells around a few whole documents would hold everybody.
Regions are therefore cut in steps that each keep every link:

1. Screen. A link leaves at most r of either set unshared, so a set with more shingles than that which no other set holds
   has no link. All documents ask for half of the universe of shingles, and those left over, a small part, for all of it.
2. First regions. The answers order each set from its rarest shingle on. If two sets link, their rarest common shingle is
   among the first r n + 1 of each, so each of these is a point through which a document is near others; documents that
   share one are in a region. Passages that many documents share are not among the rarest and bind nothing together.
3. Voronoi cells. A region that is too large for a task is split: members become pivots, each document goes home to the cell
   of its nearest pivot at distance b, if b <= 2 r, or else to the rest. By the triangle inequality a document that is
   linked with one at home in the cell of pivot p is within min(b + 2 r, 3 r) of p, and b > r if linked with one of the rest,
   so only documents within these windows visit. This repeats on cells that are still too large. A region whose windows
   would copy most of it is dealt into blocks instead, every two of which meet in a task of their own.
4. Exact join. In a task, documents become pivots in turn; size and distances to earlier pivots exclude most others before
   shingles are compared. Every pair of different sets within a cell is decided exactly, and only classes and counts leave.

Documents with equal sets are one node. Sets are of 64-bit shingle hashes, equal sets are found by 128 bits, and nodes are
told apart by 64.

Defined cases: a null or empty text, or one without words, has an empty set and is a class of its own; repeated rows are
linked with each other; rows with one id and different texts are documents of their own; a null doc_id is no node and has a
null class; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .exchange import BUCKET_BYTES, SENT, answer_seen, batch_of, bucket_count, bucket_of, chunk_id, exchange, gather, name_rows, named_rows, pack, split, text_bytes, unpack
from .io import discard, fresh, keep, map_batches, may_be_in, ship, table

SIZE = 3
#: Links: 100 * intersection >= LIMIT * union.
LIMIT = 90
#: Shingles and documents of a region that one task joins, and splits of a region at most.
REGION_SHINGLES, REGION_DOCS, SPLITS = 1_000_000, 1024, 4
#: Documents of a region per pivot, and pivots of one split at least and at most.
PER_PIVOT, PIVOTS = 64, (16, 256)
#: Copies of a document that windows may make, on average; beyond it blocks are used.
GROWTH = 2.5
#: Members of a region that one task compares with its pivots, and their shingles on average.
PART, PART_SHINGLES = 256, 1_000_000

#: Bytes of text that a task works on at once; its arrays take some 30 times as much.
CHUNK = 2 << 20

U64 = np.uint64


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each document, and where each document begins (one more entry at the end)."""
    buf = tk.lower(buf)
    starts, ends, first = tk.words(buf, offs, tk.NONSPACE)
    h = tk.hash_words(buf, starts, ends)
    at = tk.within(first, size)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.where(n > 0, 1, 0))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(begin[-1]), np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    regular = np.ones(len(out), bool)
    regular[begin[short]] = False
    out[regular] = tk.window_hash(h, size)[at] if len(at) else 0
    for d in short:
        out[begin[d]] = tk.window_hash(h[first[d] : first[d + 1]], int(n[d]))[0]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][begin[:-1] < len(out)]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def _fingerprints(flat: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return [_sum(tk.mix(flat ^ U64(c)), begin).view(np.int64) for c in (0x1B03738712FAD5C9, 0xF6E9D1C8B5A79283)]


def _screened(s: np.ndarray) -> np.ndarray:
    """The half of the universe of shingles that the screen asks for."""
    return (s >> U64(40)) & U64(1) == 0


SETS = "doc_id long, mark long, n long, fp1 long, fp2 long, lone long"


def _send_screened(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, named = named_rows(batch)
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in tk.chunks(batch.column(1), CHUNK):
                flat, begin = shingle_sets(buf, offs, size)
                doc = tk.owner(begin)
                some = named[i:j][doc] & _screened(flat)
                chunk, number = chunk_id(number), number + 1
                rows, code = name_rows(flat[some], buckets, chunk)
                docs = np.stack([ids[i:j], named[i:j], np.bincount(doc[some], minlength=j - i), marks[i:j], np.diff(begin), *_fingerprints(flat, begin)]).astype(np.int64)
                yield batch_of([*rows, (-1, chunk, j - i, code, None, docs.tobytes())])

    return run


def _sets_of(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        seen, docs, _ = gather(group, buckets, 7)
        ids, named, per, mark, n, fp1, fp2 = docs
        lone = tk.per_document(~seen, np.concatenate([[0], np.cumsum(per)]))
        cols = [pa.array(ids, mask=named == 0), *map(pa.array, (mark, n, fp1, fp2, lone))]
        return pa.table(cols, names=["doc_id", "mark", "n", "fp1", "fp2", "lone"])

    return run


def screen(text: DataFrame, size: int, buckets: int) -> DataFrame:
    """A row per row of ``text`` (doc_id, text, mark): size and fingerprints of its set and, of the shingles in half of the
    universe, how many no other row holds."""
    return exchange(map_batches(text, None, SENT, whole=_send_screened(size, buckets)), answer_seen, _sets_of(buckets), SETS, "sets")


BODIES = "node long, n long, copies long, shingles binary"


def _bodies(size: int):
    """Sets as bytes; columns doc_id, text, node, copies."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, buf, offs in tk.chunks(batch.column(1), CHUNK):
            flat, begin = shingle_sets(buf, offs, size)
            raw = flat.tobytes()
            bodies = pa.array([raw[8 * a : 8 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), pa.array(np.diff(begin)), batch.column(3).slice(i, j - i), bodies], ["node", "n", "copies", "shingles"])

    return work


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The sets of a column of bytes, one after the other."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint64)


def _send_counts(buckets: int):
    """Every distinct shingle of a chunk with the number of sets that hold it; the chunk's own row carries its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            at = np.concatenate([[0], np.cumsum(n)])
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK // 8, side="right")) - 1)
                flat = _flat(batch.column(3).slice(i, j - i))
                u, count = np.unique(flat, return_counts=True)
                order, begin = split(bucket_of(u, buckets), buckets)
                chunk, number, rows = chunk_id(number), number + 1, []
                for b in np.flatnonzero(np.diff(begin)).tolist():
                    own = order[begin[b] : begin[b + 1]]
                    rows.append((b, chunk, len(own), pack(u[own]), count[own].astype(np.uint32).tobytes(), None))
                docs = np.stack([batch.column(0).slice(i, j - i).to_numpy(), n[i:j]]).astype(np.int64)
                yield batch_of([*rows, (-1, chunk, j - i, flat.tobytes(), None, docs.tobytes())])
                i = j

    return run


def _answer_ranks(group: pa.Table) -> pa.Table:
    """For each shingle asked for a byte: 0 if one set holds it, else one that grows with the number of sets."""
    names = [unpack(x.as_py()) for x in group.column("body")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("who")])
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(back, counts)
    rank = np.where(total > 1, np.ceil(4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)[back]
    at = np.cumsum([0, *map(len, names)])
    bodies = [rank[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    none = pa.nulls(len(bodies), pa.binary())
    return pa.table([group.column("bucket"), group.column("chunk"), group.column("head"), pa.array(bodies, pa.binary()), none, none], names=["bucket", "chunk", "head", "body", "who", "docs"])


def rarest(flat: np.ndarray, rank: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set that may have a link, those of its first shingles, in the order of rank and hash, that others hold too;
    and whose they are."""
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    lone = np.bincount(doc[rank == 0], minlength=len(n))
    may = 100 * (n - lone) >= limit * n
    order = np.lexsort((flat, rank, doc))
    first = np.arange(len(flat)) - begin[doc] < (n + 1 - -(-limit * n // 100))[doc]
    chosen = order[first]
    chosen = chosen[(rank[chosen] > 0) & may[doc[chosen]]]
    return flat[chosen], doc[chosen]


def _rare_points(buckets: int, limit: int):
    def run(group: pa.Table) -> pa.Table:
        answers = {r["bucket"]: r for r in group.to_pylist()}
        own = answers.pop(-1)
        flat = np.frombuffer(own["body"], np.uint64)
        node, n = np.frombuffer(own["docs"], np.int64).reshape(2, -1)
        u, back = np.unique(flat, return_inverse=True)
        order, begin = split(bucket_of(u, buckets), buckets)
        rank = np.zeros(len(u), np.uint8)
        for b, r in answers.items():
            rank[order[begin[b] : begin[b + 1]]] = np.frombuffer(r["body"], np.uint8)
        point, doc = rarest(flat, rank[back], n, limit)
        return pa.table([pa.array(point.view(np.int64)), pa.array(node[doc])], names=["point", "a"])

    return run


#: Groups that the documents of a common point are first dealt into.
SALT = 64


def first_regions(bodies: DataFrame, limit: int, bucket_bytes: int) -> DataFrame:
    """node, label: the region of each set that shares a rare point with another."""
    size = 8 * int(bodies.agg(F.sum("n")).first()[0] or 0)
    buckets = bucket_count(size, bucket_bytes)
    sent = map_batches(bodies, None, SENT, whole=_send_counts(buckets))
    points = exchange(sent, _answer_ranks, _rare_points(buckets, limit), "point long, a long", "points")
    # the documents of a point follow the least of their group, and the groups of a point the least of these
    dealt = points.withColumn("group", F.pmod(F.xxhash64("a"), F.lit(SALT)))
    near = dealt.select("point", "a", F.min("a").over(Window.partitionBy("point", "group")).alias("b"))
    heads = near.select("point", F.col("b").alias("a")).distinct()
    far = heads.select("a", F.min("a").over(Window.partitionBy("point")).alias("b"))
    edges = keep(near.select("a", "b").unionByName(far).where("a <> b").distinct(), "pivots")
    found = components(edges)
    discard(points)
    discard(edges)
    return found


def _sum(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return c[begin[1:]] - c[begin[:-1]]


def common_with(local: np.ndarray, begin: np.ndarray, of: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Marked shingles of each of the sets ``of``."""
    c = begin[of + 1] - begin[of]
    at = np.repeat(begin[of] - (np.cumsum(c) - c), c) + np.arange(c.sum())
    return np.add.reduceat(mark[local[at]].astype(np.int64), np.cumsum(c) - c)


def join_region(n: np.ndarray, flat: np.ndarray, side: np.ndarray, copies: np.ndarray, limit: int = LIMIT, references: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """For the documents of a region, the smallest number that each reaches over links, and its links, copies counted.

    ``flat`` holds the sets one after the other. Documents of side 0 meet only those of side 1; side 2 meets all. Each document is a
    pivot once for those after it; the size window and the distances to the first ``references`` pivots exclude. Of linked
    pairs nothing is kept but the classes and the counts."""
    m = len(n)
    begin = np.concatenate([[0], np.cumsum(n)])
    _, local = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, bool)
    across = bool(len(side)) and side.min() < 2
    order = np.argsort(n, kind="stable")
    size, sides = n[order], side[order]
    distances: list[np.ndarray] = []
    root, links = np.arange(m), np.zeros(m, np.int64)
    r = 1 - limit / 100 + 1e-9
    for k in range(m):
        p = order[k]
        high = int(np.searchsorted(limit * size, 100 * size[k], side="right"))  # sizes ascend
        near = np.arange(k + 1, high)
        reference = len(distances) < references
        if reference:
            near = np.arange(m)
        else:
            if across:
                near = near[sides[near] != sides[k]]
            for d in distances:
                near = near[np.abs(d[near] - d[k]) <= r]
        if not len(near):
            continue
        own = local[begin[p] : begin[p + 1]]
        mark[own] = True
        of = order[near]
        common = common_with(local, begin, of, mark)
        mark[own] = False
        union = n[of] + n[p] - common
        if reference:
            distances.append(1 - common / union)
        linked = (100 * common >= limit * union) & (near > k)
        if across:
            linked &= sides[near] != sides[k]
        of = of[linked]
        if len(of):
            links[p] += copies[of].sum()
            links[of] += copies[p]
            met = np.unique(np.append(root[of], root[p]))
            if len(met) > 1:
                to = np.arange(m)
                to[met] = met[0]
                root = to[root]
    return root, links


FOUND = "a long, b long, links_a long"


def _join_bucket(limit: int):
    def join(group: pa.Table) -> pa.Table:
        """The regions of a bucket, one after the other: per document an edge to the root of its class in the region, so
        that the edges span all links, and its links if at home."""
        region = group.column("region").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        side, home = group.column("side").to_numpy(), group.column("home").to_numpy()
        body = group.column("shingles").to_pylist()
        order = np.argsort(region, kind="stable")
        cut = np.flatnonzero(np.diff(region[order], prepend=region[order][0] - 1 if len(order) else 0)) if len(order) else []
        out_a, out_b, out_n = [], [], []
        for a, b in zip(cut, [*cut[1:], len(order)]):
            own = order[a:b]
            if len(own) < 2:
                continue
            sets = [np.frombuffer(body[k], np.uint64) for k in own]
            root, links = join_region(np.array([len(x) for x in sets], np.int64), np.concatenate(sets), side[own], copies[own], limit)
            got = links > 0
            out_a.append(node[own][got])
            out_b.append(node[own][root[got]])
            out_n.append(np.where(home[own], links, 0)[got])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(cat(x)) for x in (out_a, out_b, out_n)], names=["a", "b", "links_a"])

    return join


MEMBERS = "region long, node long, n long, copies long, shingles binary, home boolean"


PLACES = "region long, node long, cells array<long>, home_cell long"


def windows(far: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For distances of documents to pivots: which cells each is in, the rest being the last, and its home."""
    r, e = 1 - limit / 100, 1e-9
    rest = far.shape[1]
    best = far.min(axis=1)
    inside = far <= np.minimum(best + 2 * r, 3 * r)[:, None] + e
    home = np.where(best <= 2 * r, far.argmin(axis=1), rest)
    return np.concatenate([inside, (best > r - e)[:, None]], axis=1), home


def _places(limit: int):
    """The cells of each document of a part of a region."""

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        region, node = left.column("region").to_numpy(), left.column("node").to_numpy()
        n, flat = left.column("n").to_numpy(), _flat(left.column("shingles"))
        pivots = right.sort_by("pivot")
        u, local = np.unique(flat, return_inverse=True)
        begin, every, mark = np.concatenate([[0], np.cumsum(n)]), np.arange(len(n)), np.zeros(len(u), bool)
        far = np.ones((len(n), max(1, pivots.num_rows)))
        for k, body in enumerate(pivots.column("body")):
            own = np.frombuffer(body.as_buffer(), np.uint64)
            held = np.minimum(np.searchsorted(u, own), len(u) - 1)
            mark[held[u[held] == own]] = True
            common = common_with(local, begin, every, mark)
            mark[:] = False
            far[:, k] = 1 - common / (n + len(own) - common)
        inside, home = windows(far, limit)
        row, cell = np.nonzero(inside)
        name = lambda of, c: tk.mix(region.view(np.uint64)[of] * U64(0x9E3779B97F4A7C15) + (c + 1).astype(np.uint64)).view(np.int64)
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)), pa.array(name(row, cell)))
        return pa.table([pa.array(region), pa.array(node), cells, pa.array(name(every, home))], names=["region", "node", "cells", "home_cell"])

    return place


def _split(members: DataFrame, sizes: DataFrame, depth: int, pivots: tuple[int, int], limit: int) -> tuple[DataFrame, DataFrame]:
    """One recursion: the members of too large regions in their Voronoi cells, and the regions that windows do not part.

    Members meet their region's pivots part by part, and are copied only once the number of copies is known."""
    known = members.join(sizes, "region").withColumn("parts", F.ceil(F.greatest(F.col("docs") / PART, F.col("shingles_in") / PART_SHINGLES)).cast("long"))
    wanted = F.least(F.greatest(F.col("docs") / PER_PIVOT, F.lit(pivots[0])), F.lit(pivots[1]))
    chance = F.greatest(F.ceil(F.col("docs") / wanted), F.lit(1))
    chosen = known.where(F.pmod(F.xxhash64("node", F.lit(depth)), chance) == 0)
    sent = chosen.select(F.col("region").alias("of"), F.col("node").alias("pivot"), F.col("shingles").alias("body"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("to"))
    dealt = known.withColumn("part", F.pmod(F.xxhash64("node", F.lit(depth + 100)), F.col("parts")))
    ship(members.sparkSession)
    placed = keep(dealt.groupBy("region", "part").cogroup(sent.groupBy("of", "to")).applyInArrow(_places(limit), PLACES), "places")
    growth = placed.groupBy("region").agg((F.sum(F.size("cells")) / F.count(F.lit(1))).alias("growth"))
    whole = growth.where(F.col("growth") > GROWTH).select("region")
    parted = placed.join(F.broadcast(whole) if _few(whole) else whole, "region", "left_anti")
    moved = members.join(parted, ["region", "node"]).withColumn("cell", F.explode("cells"))
    cells = moved.select(F.col("cell").alias("region"), "node", "n", "copies", "shingles", (F.col("home") & (F.col("cell") == F.col("home_cell"))).alias("home"))
    return keep(cells, "cells"), keep(whole, "whole")


def _few(names: DataFrame, most: int = 100_000) -> bool:
    return names.limit(most + 1).count() <= most


def link_sets(members: DataFrame, limit: int = LIMIT, most: int = REGION_SHINGLES, most_docs: int = REGION_DOCS, pivots: tuple[int, int] = PIVOTS, splits: int = SPLITS) -> DataFrame:
    """(a, b, links_a): each linked document with the root of its class in its cell, and its links in the cells where it is
    at home. ``members`` has a row per region and document."""
    columns = ["region", "node", "n", "copies", "shingles", "home"]
    ready, rest = [], members.select(columns)
    for depth in range(splits + 1):
        sizes = keep(rest.groupBy("region").agg(F.sum("n").alias("shingles_in"), F.count(F.lit(1)).alias("docs")), "regions")
        large = sizes.where((F.col("shingles_in") > most) | (F.col("docs") > most_docs))
        if large.isEmpty():
            ready.append(rest.withColumn("side", F.lit(2)))
            break
        names = large.select("region")
        ready.append(rest.join(names, "region", "left_anti").select(*columns, F.lit(2).alias("side")))
        rest = rest.join(names, "region", "left_semi").select(columns)
        if depth == splits:
            ready.append(_tiles(rest, large, most, most_docs).select(*columns, "side"))
        else:
            cells, whole = _split(rest, large, depth, pivots, limit)
            ready.append(_tiles(rest, large.join(whole, "region"), most, most_docs).select(*columns, "side"))
            rest = cells
    every = ready[0]
    for x in ready[1:]:
        every = every.unionByName(x)
    total, docs = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = int(max(256, -(-16 * total // most), -(-16 * docs // most_docs)))  # small beside a large region, so that tasks even out
    return every.groupBy(F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket")).applyInArrow(_join_bucket(limit), FOUND)


def _tiles(members: DataFrame, sizes: DataFrame, most: int, most_docs: int) -> DataFrame:
    """What pivots do not part: blocks of documents, each two of which meet as a region of their own."""
    blocks = F.ceil(F.greatest(2 * F.col("shingles_in") / most, 2 * F.col("docs") / most_docs)).cast("long")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.join(sizes, "region").withColumn("blocks", blocks).withColumn("block", block)
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.withColumn("region", F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", F.when(F.col("block") == F.col("other"), F.lit(2)).otherwise((F.col("block") > F.col("other")).cast("int")))


def near_classes(docs: DataFrame, size: int = SIZE, limit: int = LIMIT, bucket_bytes: int = BUCKET_BYTES // 2, **regions_of) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, one row per document row: links are pairs whose sets of ``size``-word
    shingles have a similarity of ``limit`` percent at least. ``mark`` is a hash of the text and ``lead`` whether the row is
    the one of its class with the least id and mark. Further parameters are those of :func:`link_sets`."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    sets = screen(text, size, bucket_count(text_bytes(docs), bucket_bytes))
    filled = sets.where("n > 0 and doc_id is not null")
    nodes = keep(filled.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min("lone").alias("lone")), "nodes")
    alive = keep(nodes.where(100 * (F.col("n") - F.col("lone")) >= limit * F.col("n")).select("first.doc_id", "first.mark", F.col("fp1").alias("node"), "copies"), "alive")
    some = may_be_in(text, F.xxhash64("doc_id", "mark"), alive.select(F.xxhash64("doc_id", "mark")), "alive").where("alive")
    bodies = keep(map_batches(some.join(alive, ["doc_id", "mark"]).select("doc_id", "text", "node", "copies"), _bodies(size), BODIES), "bodies")
    regions = first_regions(bodies, limit, bucket_bytes)
    members = bodies.join(regions, "node").select(F.col("label").alias("region"), "node", "n", "copies", "shingles", F.lit(True).alias("home"))
    members = keep(members.dropDuplicates(["region", "node"]), "members")  # repeated rows of a node are one
    discard(bodies)
    found = keep(link_sets(members, limit, **regions_of), "links")
    discard(members)
    labels = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links_a").alias("links"))
    linked = nodes.join(labels.join(links, "node"), F.col("fp1") == F.col("node")).select("fp1", "fp2", "first", "label", "links")
    linked = keep(linked, "linked")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    known = nodes.select("fp1", "fp2", "first", "copies").join(linked.join(least, "label").select("fp1", "fp2", "least", "links"), ["fp1", "fp2"], "left")
    known = known.select("fp1", "fp2", F.coalesce("least", "first").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.join(known, ["fp1", "fp2"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(own, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "mark", F.when(own, F.col("least") == F.struct("doc_id", "mark")).otherwise(F.lit(True)).alias("lead"),
    )


def lead_documents(docs: DataFrame, size: int = SIZE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one stays of each class; rows that repeat an id and a text are one.
    Only rows that may go are shuffled."""
    id_, mark, flag = (fresh(x, docs.columns) for x in ("id", "mark", "flag"))
    classes = near_classes(docs, size, limit).groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg(F.bool_and("lead").alias("lead"), F.count(F.lit(1)).alias("rows"))
    odd = keep(classes.where("not lead or rows > 1").select(id_, mark, "lead"), "odd")
    marked = may_be_in(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), odd.select(F.xxhash64(id_, mark)), flag)
    some = marked.where(F.col(flag)).withColumn(mark, F.xxhash64("text"))
    gone = odd.where("not lead").select(id_, F.col(mark).alias(flag))
    left = some.drop(flag).join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(mark) == F.col(flag)), "left_anti")
    return marked.where(~F.col(flag)).select(docs.columns).unionByName(left.dropDuplicates(["doc_id", mark]).select(docs.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 90 * (ca.n + cb.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, cast(coalesce(n, 0) AS bigint) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, cast(coalesce(n_links, 0) AS bigint) AS n_links
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""
