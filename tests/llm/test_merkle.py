"""The manifest against a plain tree: groups of every size, nulls, ties, repeated rows, clashing columns and an empty table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _tree(leaves, fanout):
    """The last node, and the siblings of each leaf level by level."""
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, at in enumerate(own):
            run = level[at // fanout * fanout :][:fanout]
            paths[k].append((run[: at % fanout], run[at % fanout + 1 :]))
        level = [_h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        own = [at // fanout for at in own]
    return level[0], paths


def _plain(rows, fanout):
    """(leaf, subroot, root, proof) of each row of (doc_id, lang, text)."""
    by = {}
    for d, lang, text in rows:
        by.setdefault(lang, []).append((d is not None, d or 0, _h(_field(d), _field(lang), _field(text)), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        trees[lang] = _tree([x[2] for x in by[lang]], fanout)
    root, tops = _tree([trees[x][0] for x in langs], fanout)
    out = []
    for lang, top in zip(langs, tops):
        for x, path in zip(by[lang], trees[lang][1]):
            out.append((x[3], x[2], trees[lang][0], root, _h(*(s for left, right in path + top for s in left + right))))
    return out


def _run(df, fanout):
    rows = df.select("doc_id", "lang", merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.col("text")]).alias("leaf"))
    got = merkle.manifest(rows, "lang", ["doc_id"], "leaf", fanout)
    return got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("fold"))


SCHEMA = "doc_id long, lang string, text string, pos int, grp string, digest string"


@pytest.mark.parametrize("fanout, sizes", [(8, {"en": 70, "de": 9, "fr": 8, None: 3, "é": 1, "": 2}), (2, {"a": 9, "b": 1}), (3, {None: 28}), (8, {"x": 1})])
def test_manifest(spark, fanout, sizes):
    rng = random.Random(5)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.choice([None, rng.randrange(10**6)]) if k % 7 == 3 else rng.randrange(10**6), lang, rng.choice([None, "", "Ä text", "x" * 50_000, str(k)])) for k in range(n)]
    rows += rows[:1] + [(rows[0][0], rows[0][1], "another text of the same id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "g", "d") for r in rows], SCHEMA).repartition(5)
    got = _run(df, fanout).collect()
    assert sorted(map(str, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got))) == sorted(map(str, _plain(rows, fanout)))
    assert all(r.fold == r.root for r in got)


def test_empty_table_and_tampering(spark, tmp_path):
    assert _run(spark.createDataFrame([], SCHEMA), 8).count() == 0
    rows = [(k, "en" if k % 3 else None, ["Some TEXT", "lower", None, ""][k % 4], "s", 5) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    import zlib

    for k, _, text, _, _ in rows:
        assert got[k].verified == (not (zlib.crc32(str(k).encode()) % 3 == 0 and text == "Some TEXT"))
        assert (got[k].folded_root == got[k].root) == got[k].verified
    assert not all(r.verified for r in got.values())
