import corpus_pipeline as P
from quillon.llm import decontaminate, jaccard


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()}
    step = docs
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"] for r in step.select("doc_id").collect()}
        step = stage(spark, step, sf).cache()
        after = {r["doc_id"] for r in step.select("doc_id").collect()}
        assert after < before and step.columns == docs.columns
        if name.startswith("quality"):
            assert len(good & after) >= 0.95 * len(good & before)
    linked = jaccard.link(step, width=5, percent=80)
    assert linked.filter("component_id != doc_id").count() == 0
    assert decontaminate.search(step, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    last = P.STAGES[-1][1](spark, step, sf)
    assert last.count() == step.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(last.columns)


def test_odd_rows_pass_through(spark, odd, none, sf):
    clash = odd.withColumnRenamed("n_chars", "kept").withColumn("hits", odd["doc_id"]).withColumn("rep", odd["doc_id"])
    for name, stage in P.STAGES:
        got = stage(spark, clash, sf)
        assert got.count() <= 14
        assert stage(spark, none, sf).count() == 0
        if stage is not P.encoding:
            assert got.columns == clash.columns
    assert sorted(r["doc_id"] or -1 for r in P.near_copies(spark, odd, sf).collect()) == [-1, 1, 3, 4, 5, 6, 8, 10, 11, 12]


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 100


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split(None)
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def chosen_copies(rows):
    """The least id of each group linked at five words and a similarity of 0.8, from all pairs; documents without words each stay."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d for d in ids if root(d) == d}


def test_every_stage_against_a_plain_version(spark, sf):
    """Rules by SQL, copies from all pairs, benchmark items by their shingles, tokens by the library; the classifier by op8's own rows, whose models have brute-force tests."""
    import hashlib
    from array import array

    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillon.llm import kneser_ney, quality_sql

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0] for r in c.execute(f"select doc_id from ({quality_sql.sql()}) where kept").fetchall()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = kneser_ney.judge(docs.filter(docs["doc_id"].isin(sorted(want))), kneser_ney.trusted_ids(labels), carry=["doc_id"], toxic=kneser_ney.toxic_ids(labels))
    want = {r["doc_id"] for r in judged.filter("kept").collect()}
    want = chosen_copies([(d, texts[d]) for d in want])
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(len(next(iter(i))) == 5 for i in items)
    want = {d for d in want if not any(100 * len(i & shingles(texts[d])) >= 80 * len(i) for i in items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = set()
    for d in want:
        ids = library.encode(texts[d] or "", add_special_tokens=False).ids
        raw = array("I", ids).tobytes()
        rows.add((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = P.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == rows
