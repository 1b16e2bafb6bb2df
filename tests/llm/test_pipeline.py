import corpus_pipeline
from tessera.llm import queries
from tests.llm.test_text_operators import shingles_of


def test_stages_take_effect_and_equal_brute_force(spark, tmp_path):
    base = [f"the quick word{i} runs over lazy thing{i} and sees another item{i} near some river{i} today" for i in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0].upper(), "en", "s", 1), (21, base[1] + " indeed", None, "s", 1), (22, "12345 !!", "en", "s", 1), (23, None, None, None, None), (24, "", "en", "s", 0), (None, "le chat est la", "fr", None, 1)]
    rows += [(30, "prefix words " + "alpha beta gamma delta epsilon zeta eta theta iota kappa" + " suffix", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen.append({r.doc_id for r in now.collect()})
    texts = {i: t for i, t, *_ in rows}
    letters = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert seen[0] == letters
    assert seen[1] == letters - {0}
    near = set(seen[1])
    for a in sorted(x for x in near if x is not None):
        for b in sorted(x for x in near if x is not None):
            if a < b and a in near and b in near:
                x, y = shingles_of(texts[a]), shingles_of(texts[b])
                if 10 * len(x & y) >= 8 * len(x | y):
                    near.discard(b)
    assert seen[2] == near and 21 not in near
    assert seen[3] == near - {30}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == near - {30} and all(r.round_trip for r in out)


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
