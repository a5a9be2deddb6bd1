import corpus_pipeline as P
from straitline.llm import jaccard

from .test_jaccard import brute


def test_stages(spark, tmp_path):
    good = lambda k: "Some clean sentence number %d about the harbour, its ships and the weather over the sea near port %d today." % (k, k * 7)
    texts = [(i, good(i)) for i in range(40)]
    texts += [(100, texts[3][1]), (101, "Mail me at jo.doe@mail1.example.com about the long list of ships that came in to the harbour."), (102, "lead in words here. the item that nobody may train on has exactly these twelve words. tail")]
    texts += [(200 + i, " | ".join(["MENU!!"] * 30)) for i in range(20)] + [(300, None), (301, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i, _ in texts if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The item that nobody may train on has exactly these twelve words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == P.STAGES[-1][0] or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = set(seen["quality_classifier"])
    assert kept >= set(range(40)) | {100, 101, 102} and not kept & set(range(200, 220))
    want = {i for i, (n, c) in brute([(i, r.text) for i, r in seen["quality_classifier"].items()]).items() if c == i}
    assert set(seen["ngram_jaccard_join"]) == want and 100 not in want
    assert set(seen["benchmark_decontamination"]) == want - {102}
    assert seen["personal_data"][101].text.startswith("Mail me at [EMAIL] about")
    mixed = seen["source_mixing"]
    assert set(mixed) == set(seen["personal_data"]) and all(r.taken <= 3 * r.size for r in mixed.values())
    total = P.run(spark, str(tmp_path))
    assert {(r.doc_id, r.taken) for r in total.collect()} == {(r.doc_id, r.taken) for r in mixed.values()}
    assert jaccard.SHINGLE_WORDS == 5
