import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import block_names

LOWER = {c: chr(ord(c) + 32) for c in map(chr, range(65, 91))}


def folded(t):
    return "".join(LOWER.get(c, c) for c in t or "")


def brute(rows):
    """(doc_id, keep_id, size, kept, digest) of rows (doc_id, text), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(folded(r[1]), []).append(r[0])
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1, 3, 4096])
def test_odd_rows(spark, odd, odd_rows, block_bytes):
    rows = [(r[0], r[1][:500] if r[1] else r[1]) for r in odd_rows] if block_bytes < 9 else [r[:2] for r in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(block_names.dedup(df, block_bytes=block_bytes)) == brute(rows)


def test_equal_blocks_in_other_orders(spark):
    """Texts of the same blocks and of blocks that begin alike are told apart at every level."""
    texts = ["aabb", "bbaa", "aabbaa", "aabbaabb", "aab", "AAB", "aab\x00", "aa", "a", "", None, "aabbaabbc", "aabbaabbcc", "ÄABB", "äabb"] * 2
    rows = list(enumerate(texts))
    assert got(block_names.dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2)) == brute(rows)


def test_keys_that_collide_are_seeded_anew(spark):
    """Under the first seed all blocks of a length share a key; the result is the same."""
    real = block_names.key
    weak = lambda block, seed: (len(block), 0) if seed == 0 else real(block, seed)
    rows = [(1, "abcd"), (2, "abce"), (3, "abcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert block_names.block_names(df, "text", 2, weak)[1] == 1
    assert got(block_names.dedup(df, block_bytes=2, keyed=weak)) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÄ\n", max_size=9)), max_size=6), st.integers(1, 5))
def test_cut_and_fold(texts, size):
    import pyarrow as pa

    for t, raw in zip(texts, block_names.folded(pa.array(texts, pa.string()))):
        assert raw.decode() == folded(t)
        parts = block_names.cut(raw, size)
        assert b"".join(parts) == raw and all(len(p) == size for p in parts[:-1]) and len(parts) >= 1


def test_kept_rows_and_clashes(spark, odd, none):
    assert block_names.dedup(none).count() == 0
    clash = odd.withColumn("kept", odd["doc_id"]).withColumn("keys", odd["text"]).withColumn("rid", odd["source"])
    kept = block_names.deduplicate(clash)
    assert kept.columns == clash.columns and kept.count() == odd.selectExpr("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").distinct().count()
    assert block_names.dedup(clash, carry=["doc_id", "kept", "rid"]).columns == ["doc_id", "rid", *block_names.RESULTS]
