import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return brute.sha("".join(said(row[c]) for c in COLUMNS))


def climb(nodes):
    """The root over nodes, and of each its siblings level by level."""
    proofs, at, below = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(below) > 1:
        runs = [below[i : i + 3] for i in range(0, len(below), 3)]
        for k, place in enumerate(at):
            run, own = runs[place // 3], place % 3
            proofs[k].append((run[:own], run[own + 1 :]))
            at[k] = place // 3
        below = [brute.sha("".join(r)) for r in runs]
    return below[0], proofs


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    root, over = climb([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, proof in zip(groups[g], trees[g][1], strict=True):
            siblings = proof + over[k]
            text = r["text"]
            if zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf({**r, "text": text})
            for before, after in siblings:
                node = brute.sha("".join([*before, node, *after]))
            proof_sha = brute.sha("".join(x for before, after in siblings for x in [*before, *after]))
            out.append((r["doc_id"], leaf(r), trees[g][0], root, proof_sha, node, node == root))
    return sorted(out, key=repr)


def table_of(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def hold(got, rows):
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_manifest_of_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = merkle.op11_merkle(spark, SMALL)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    hold(got, rows)
    assert 0 < got.where("verified").count() < len(rows)


@pytest.mark.parametrize(("levels", "most", "top"), [(1, 9, 9), (2, 9, 3), (1, 1, 4), (2, 2, 1)])
def test_trees_of_several_blocks_and_many_groups(spark, monkeypatch, tmp_path, levels, most, top):
    """A hot group, groups of one row and just a block, equal rows and keys, nulls; more groups and blocks than the driver's bound."""
    draw = random.Random(levels)
    rows = [(i, "hot", "en", i, f"text {i}\nof {i % 5}") for i in range(200)]
    rows += [(i, draw.choice([None, "", "é", "z", *map(str, range(40))]), None, None, draw.choice([None, "", "a\nb"])) for i in range(1000, 1120)]
    rows += [(7, "same", "en", 1, "x\ny")] * 31 + [(7, "same", "en", 2, "x")] * 3 + [(None, "hot", None, None, "n\n")] * 2 + [(i, "nine", "", 0, "t") for i in range(9)]
    original = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda docs, changed: original(docs, changed, least_levels=levels, most_levels=most, most_top=top))
    hold(merkle.op11_merkle(spark, table_of(spark, rows, tmp_path)), [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])


def test_one_row_and_none(spark, tmp_path):
    one = [(5, "s", "en", 1, "a\nb")]
    (r,) = merkle.op11_merkle(spark, table_of(spark, one, tmp_path / "one")).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == brute.sha("")
    assert merkle.op11_merkle(spark, table_of(spark, [], tmp_path / "none")).count() == 0


def test_proofs_of_the_operator_itself(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.lit(1) for c in ("group", "key", "rest", "at", "part", "block", "siblings", "top", "path")})
    m = merkle.manifest(docs)
    assert m.where(merkle.folded(F.col("leaf"), F.col("siblings")) != F.col("root")).count() == 0 and m.where("leaf <> changed_leaf").count() == 0
    assert m.count() == docs.count()
