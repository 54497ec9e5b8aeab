"""Queries against their SQL on texts that the small tables lack: accents at word edges, repeated capitals, lines at the edge."""

import duckdb
import pandas as pd
import pytest
from test_queries import rows

from quillon.plans import all_queries

CAPITALS = "ÈA RENAB TUNOR PORED SELAM MIRUS LUNAR DORIN KELAB ÑU"  # with ASCII edges a prose cue stands behind the È
TEXTS = [
    CAPITALS, CAPITALS.replace("È", "E"), "DAS IST (EIN) SATZ; MIT (VIEL) ZEICHEN; UND (MEHR) DAVON; NOCH (EINS) DAZU",
    "word éDAten " + "of a longer text that has ninety characters or more in it, so that its words may count as glued",
    "word DAten " + "of a longer text that has ninety characters or more in it, so that its words may count as glued",
    "the USA USA are named twice in a text of more than eighty characters, which glues none of its words",
    "ab " * 489 + "abc",  # 60 lines of 24.5 characters
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("texts")
    texts = TEXTS + [("q " * n).strip() + "!" * (n % 2) for n in range(1, 200)]
    made = ["\n".join([t] * 20) for t in texts[: len(TEXTS)]] + ["\n".join(texts[i : i + 40]) for i in range(len(TEXTS), len(texts), 40)]
    pd.DataFrame({"doc_id": range(1, len(made) + 1), "lang": "en", "source": "web", "text": made}).to_parquet(path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["a24_unit_candidates", "f07_batchable", "f11_code_literal", "f15_english_prose", "f33_mixed_decision", "m04_fit"])
def test_like_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got, want = rows(all_queries.QUERIES[name](spark, folder).toPandas()), rows(duck.execute(all_queries.ORACLES[name]).df())
    assert got == want
