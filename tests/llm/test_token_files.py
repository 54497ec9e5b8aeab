import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillon.llm import token_files

RANKS = P.path("byte_bpe_50k.tiktoken")


def coder():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def test_counts_of_odd_rows(odd, none):
    c = coder()
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_files.count(odd, RANKS, P.PATTERN, 50256).collect())
    assert got == sorted((r["doc_id"] or -1, len(c.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert token_files.count(none, RANKS, P.PATTERN, 50256).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(6)
    want, names = [], []
    for f in range(3):
        sizes = [0, 0, 5, 1, 0, 40, 3, 0][: 8 - f]
        tokens = np.concatenate([np.append(rng.integers(0, 99, n), 100) for n in sizes])
        tokens = tokens[:-1] if f == 1 else tokens
        names.append((f"file://{tmp_path}/{f}.tokens",))
        (tmp_path / f"{f}.tokens").write_bytes(tokens.astype("<u2").tobytes())
        closed = [True] * len(sizes)
        if f == 1:
            closed[-1] = False
        want += [(f, i, n, ok) for i, (n, ok) in enumerate(zip(sizes, closed)) if ok or n]
    (tmp_path / "empty.tokens").write_bytes(b"")
    names.append((f"file://{tmp_path}/empty.tokens",))
    got = token_files.scan(spark.createDataFrame(names, "file string"), 100, block_bytes=block).collect()
    assert sorted((int(r["file"][-8]), r["ordinal"], r["n_tokens"], r["closed"]) for r in got) == want


def test_extra_columns_and_release(spark, odd):
    from quillon.llm import common

    mark = common.written_so_far()
    clash = odd.withColumnRenamed("lang", "file").withColumnRenamed("source", "n_tokens")
    assert token_files.count(clash, RANKS, P.PATTERN, 50256).count() == 14
    made = common._written[mark:]
    import os

    assert len(made) == 2 and all(os.path.isdir(p) for p in made)
    common.release(spark, mark)
    assert not any(os.path.exists(p) for p in made) and common.written_so_far() == mark
