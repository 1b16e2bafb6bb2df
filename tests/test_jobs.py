import json

import pytest

from tessera.__main__ import main
from tests.test_pipeline_parts import PAGE


def test_jobs_from_pages_to_release(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame([(1, PAGE), (2, PAGE)], "page_id long, html string").write.parquet(at("pages"))
    main(["blocks", at("pages"), at("blocks")], spark)
    with pytest.raises(Exception, match="(?i)exists"):
        main(["blocks", at("pages"), at("blocks")], spark)
    main(["blocks", at("pages"), at("blocks"), "--overwrite"], spark)
    main(["chunks", at("blocks"), at("chunks")], spark)
    main(["embed", at("chunks"), at("vectors"), "--width", "16"], spark)
    main(["report", at("blocks"), at("report")], spark)
    main(["promote", at("data"), "r1", "--table", f"blocks={at('blocks')}", "--table", f"chunks={at('chunks')}", "--preflight-only"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"problems": []}
    main(["promote", at("data"), "r1", "--table", f"blocks={at('blocks')}", "--table", f"chunks={at('chunks')}"], spark)
    assert capsys.readouterr().out.strip().endswith("data/v1")


def test_search_and_evaluate(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    spark.createDataFrame([(1, "red apple pie"), (2, "green pear"), (3, "red car")], "doc_id long, text string").write.parquet(at("docs"))
    spark.createDataFrame([(7, "red apple"), (8, "pear")], "item_id long, text string").write.parquet(at("queries"))
    spark.createDataFrame([(7, 1), (8, 2)], "qid long, doc_id long").write.parquet(at("gold"))
    main(["search", at("docs"), at("queries"), at("hits"), "--k", "5"], spark)
    main(["fuse", at("fused"), "--list", at("hits"), "--list", at("hits")], spark)
    main(["evaluate", at("fused"), at("gold"), at("docs"), at("metrics")], spark)
    rows = spark.read.parquet(at("metrics")).collect()
    assert {r.qid: r.recall_at_1 for r in rows} == {7: 1.0, 8: 1.0}
    spark.createDataFrame([(7, 99)], "qid long, doc_id long").write.parquet(at("bad"))
    with pytest.raises(ValueError, match="1 gold items"):
        main(["evaluate", at("fused"), at("bad"), at("docs"), at("m2")], spark)
