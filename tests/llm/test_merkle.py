import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, arity):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, i, arity):
    out = []
    for level in levels[:-1]:
        first = i // arity * arity
        out += [h for k, h in enumerate(level[first : first + arity]) if first + k != i]
        i //= arity
    return out


def brute(rows, arity):
    """(doc_id, leaf, subroot, root, proof digest) of rows in FIELDS' order, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]], arity)
    top = climb([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            proof = siblings(trees[g], i, arity) + siblings(top, k, arity)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(*proof)))
    return sorted(out, key=str)


def made(df, arity=2, **more):
    return merkle.manifest(df, [F.col(c) for c in FIELDS], "lang", "doc_id", arity=arity, carry=["doc_id"], **more)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_odd_rows(spark, odd, odd_rows, arity):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    got = made(odd, arity).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, arity)
    assert all(r.verified and r.folded_root == r.root for r in got)


@pytest.mark.parametrize(("piece", "stride", "arity"), [(1, 1, 2), (3, 2, 2), (7, 2, 3)])
def test_frontiers_over_several_rounds(spark, piece, stride, arity):
    """Pieces of a few leaves leave frontiers that are shuffled again and again."""
    rows = [(i, f"s{i % 3}", ["en", "de", None, "fr"][i % 37 % 4 if i % 37 else 3], i, "x" * (i % 5)) for i in range(150)] + [(999, "s", "xx", 1, "one leaf")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = made(df, arity, piece=piece, stride=stride)
    assert sorted((tuple(r)[:5] for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256").collect()), key=str) == brute(rows, arity)
    assert got.filter("not verified").count() == 0


def test_pieces_hold_every_row():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(k, k + 30_000))}) for k in range(0, 210_000, 30_000)]
    pieces = list(merkle._pieces(batches))
    assert [sum(b.num_rows for b in p) for p in pieces] == [65536, 65536, 65536, 210_000 - 3 * 65536]
    assert [x for p in pieces for b in p for x in b.column(0).to_pylist()] == list(range(210_000))


def test_tampered_leaves_do_not_verify(odd):
    other = F.when(F.col("doc_id") % 2 == 0, merkle.leaf(*(F.col(c) if c != "n_chars" else F.col(c) + 1 for c in FIELDS)))
    got = {(r.doc_id, r.verified) for r in made(odd, claimed=other).collect()}
    assert got == {(i, i is None or i % 2 == 1 or i in nulls(odd)) for i in [r[0] for r in odd.select("doc_id").collect()]}


def nulls(odd):
    return {r[0] for r in odd.filter("n_chars is null").select("doc_id").collect()}


def test_empty_and_clashing_columns(odd, none):
    assert made(none).count() == 0
    clash = odd.withColumn("root", F.lit(1)).withColumn("path", F.lit(2)).withColumn("g", F.lit(3))
    got = merkle.manifest(clash, [F.col("doc_id"), F.col("path")], "lang", "doc_id")
    assert got.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "path"] and len(set(got.columns)) == len(got.columns) and got.count() == 14
