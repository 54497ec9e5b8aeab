"""Queries that must not cut the texts they compare."""

import difflib

from quillon.plans import all_queries


def test_copy_similarity_reads_whole_turns(spark, tmp_path):
    same = "the first part of both turns is alike and long " * 10
    turns = [(1, 0, same + "then one goes on about rivers " * 8), (1, 1, same + "while the other 12345 67890 ends " * 9), (1, 2, same), (2, 0, "short"), (2, 1, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["ratio"] for r in all_queries.QUERIES["c13_copy_similarity"](spark, str(tmp_path)).collect()}
    before = {}
    for c, t, text in turns:
        a = before.get(c, "")
        want = 1.0 if a == text else difflib.SequenceMatcher(None, a, text or "").ratio()
        assert abs(got[c, t] - want) < 1e-12
        before[c] = text
    assert len(same) > 400 and got[1, 1] < 1.0
