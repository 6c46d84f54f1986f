"""The pipeline against the same stages done by hand on one machine."""

from foliospark.llm import packing, simhash, token_counts

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in c.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for s in seen[1:-1]:
        assert s.columns == docs.columns and s.dtypes == docs.dtypes
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert ids[0] >= ids[1] >= ids[2] == ids[3] == ids[4]
    texts = {r.doc_id: r.text for r in seen[1].collect()}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    near = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True)) <= simhash.RADIUS
    for i, p in prints.items():
        assert i in ids[2] or any(j < i and q and near(p, q) for j, q in prints.items()) or any(q and j != i and near(p, q) for j, q in prints.items())
    kept = [(i, prints[i]) for i in sorted(ids[2]) if prints[i]]
    assert not any(near(p, q) for k, (_, p) in enumerate(kept) for _, q in kept[:k])
    packed = seen[4].groupBy("doc_id").sum("n_tokens").collect()
    want = {r.doc_id: r.n_tokens for r in token_counts.token_counts(seen[3]).collect()}
    assert {r[0]: r[1] for r in packed} == want
    assert sorted(map(str, c.run(spark, SF).collect())) == sorted(map(str, seen[4].collect()))
    assert packing.TIERS[-1] >= seen[4].agg({"n_tokens": "max"}).first()[0]
