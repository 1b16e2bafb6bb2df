import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import audit, bm25, chunker, chunking, fusion, html, logical, metrics, migration, providers, release, retrieve, scope
from tessera.sources import tables as sources
from tessera.streaming import ingest

CONFIG = {"schema_version": 3, "table_schema_version": 2, "chunk_size": 40, "chunk_overlap": 8, "length_function": "tokens", "strategy": "recursive", "separators": ["\n\n", "\n", ". ", " ", ""]}
PAGE = (
    "<p><b>Item 1. Business</b></p>" + "".join(f"<p>Sentence {i} has some words in it. And more of them follow here.</p>" for i in range(20))
    + "<p><b>Item 8. Financial Statements</b></p><table><tr><th>Item</th><th>2024</th></tr><tr><td>Cash</td><td>$ 1</td></tr><tr><td>Debt</td><td>$ 2</td></tr></table><ul><li>one</li><li>two</li></ul>"
)


@pytest.fixture(scope="module")
def blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE.replace("words", "tokens")), (3, None)], "page_id long, html string")
    return html.html_blocks(pages, whole_body=False).cache()


@pytest.mark.parametrize("strategy", ["recursive", "fixed"])
def test_chunks_cover_all_blocks(spark, blocks, strategy):
    config = {**CONFIG, "strategy": strategy}
    chunks = chunker.chunk_blocks(blocks, config).cache()
    assert audit.block_violations(blocks).collect() == []
    assert audit.chunk_violations(chunks, blocks, 40).collect() == []
    rows = chunks.filter("doc = 1").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(1, len(rows) + 1)) and rows[0].chunk_id == "1-CHUNK-000001"
    assert sum(r.content_type == "table" for r in rows) == 1
    narrative = [r for r in rows if r.content_type == "narrative" and r.section.startswith("Item 1")]
    assert len(narrative) > 5 and all(a.source_text_start < b.source_text_start for a, b in zip(narrative, narrative[1:]))
    report = {r.doc: r for r in audit.filing_report(blocks).collect()}
    assert report[None].blocks == report[1].blocks + report[2].blocks and report[1].logical_tables == 1


def test_config_is_checked():
    with pytest.raises(ValueError, match="chunk_overlap"):
        chunker.validate_config({**CONFIG, "chunk_overlap": 40})
    assert chunker.config_sha256(CONFIG) == chunker.config_sha256(dict(reversed(CONFIG.items())))


def test_recursive_windows_respect_size_and_order():
    body = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(25)) + "." for i in range(6)) + " " + "z" * 30
    spans = chunking.recursive_windows(body, 30, 5)
    assert spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(a < c and b < d for (a, b), (c, d) in zip(spans, spans[1:]))
    import regex

    assert all(len(regex.findall(text.TOKEN, body[a:b])) <= 30 for a, b in spans)
    assert chunking.recursive_windows("", 5, 1) == [] and chunking.recursive_windows("one two", 5, 1) == [(0, 7)]


def test_scope_detection(spark):
    cases = {
        "What does Tesla say?": ("single_company", ["TSLA"]), "How do Waymo and Mobileye differ from the rest": ("anchored_global", ["MBLY", "GOOGL"]),
        "Which companies use lidar, like Ouster?": ("enumeration", ["OUST"]), "Is GM ahead of competitors": ("anchored_global", ["GM"]), "the industry": ("global", []),
        "Ford vs qualcomm": ("explicit_subset", ["F", "QCOM"]), "afford a f": ("global", []), "gm.": ("single_company", ["GM"]), None: ("global", []),
    }
    got = {r.q: (r.scope, r.companies) for r in scope.with_scope(spark.createDataFrame([(q,) for q in cases], "q string"), "q").collect()}
    assert got == cases


def scored(spark, rows):
    return spark.createDataFrame(rows, "qid long, doc_id long, score double")


def test_scope_aware_branches(spark):
    rng = np.random.default_rng(0)
    queries = [(0, "global", []), (1, "single_company", ["A"]), (2, "explicit_subset", ["A", "B"]), (3, "enumeration", []), (4, "anchored_global", ["C"])]
    tickers = {d: "ABCD"[d % 4] for d in range(40)}
    lists = [[(q, d, float(rng.random())) for q in range(5) for d in range(40)] for _ in range(2)]
    got = retrieve.scope_aware(
        spark.createDataFrame(queries, "qid long, scope string, companies array<string>"), scored(spark, lists[0]), scored(spark, lists[1]),
        spark.createDataFrame(list(tickers.items()), "doc_id long, ticker string"), "doc_id", "ticker", top_k=6, candidate_k=12, anchored_k=2,
    ).collect()

    def fuse(q, keep):
        rrf = {}
        for rows in lists:
            order = sorted((x for x in rows if x[0] == q and keep(x[1])), key=lambda x: (-x[2], x[1]))[:12]
            for r, (_, d, _) in enumerate(order):
                rrf[d] = rrf.get(d, 0) + 1 / (61 + r)
        return sorted(rrf, key=lambda d: (-round(rrf[d], 12), d)), rrf

    by = {q: [r.doc_id for r in sorted((x for x in got if x.qid == q), key=lambda x: x.position)] for q, *_ in queries}
    assert by[0] == fuse(0, lambda d: True)[0][:6]
    assert by[1] == fuse(1, lambda d: tickers[d] == "A")[0][:6] and by[2] == fuse(2, lambda d: tickers[d] in "AB")[0][:6]
    top = fuse(4, lambda d: True)[0][:6]
    extra = [d for d in fuse(4, lambda d: tickers[d] == "C")[0][:2] if d not in top]
    assert by[4] == top + extra
    assert len(by[3]) == 6 and {r.origin for r in got if r.qid == 3} <= {"representative", "fill"}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Apple pie of the banana"), (8, None)], "item_id long, text string")
    got = {r.doc_id: r.score for r in bm25.scores(asked, bm25.build(docs)).collect()}
    avg = 5 / 4
    idf = lambda df: np.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: idf(1) * part(2, 3) + idf(2) * part(1, 3), 2: idf(2) * part(1, 2)})


def test_coverage_takes_turns(spark):
    hits = spark.createDataFrame([(1, "a", d, 1.0 / d, d) for d in range(1, 6)] + [(1, "b", d, 0.1 / d, d - 10) for d in range(11, 16)] + [(1, "b", 1, 0.01, 9)], "qid long, sub string, doc_id long, rrf double, rank int")
    got = [(r.doc_id, r.reason) for r in fusion.context_coverage(hits, "doc_id", final_k=5).orderBy("position").collect()]
    assert got[:4] == [(1, "coverage"), (11, "coverage"), (2, "coverage"), (3, "score")] or [d for d, r in got if r == "coverage"][:3] == [1, 11, 2]
    assert len(got) == 5


def test_metrics_by_hand(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "qid long, doc_id long")
    run = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (1, 10, 4), (2, 5, 1)], "qid long, doc_id long, rank int")
    got = {r.qid: r for r in metrics.per_query(gold, run, "doc_id", (1, 5)).collect()}
    assert (got[1].recall_at_1, got[1].recall_at_5, got[1].complete_at_5, got[1].mrr_at_5) == (0.5, 1.0, 1, 1.0)
    assert (got[2].hit_at_5, got[2].mrr_at_5) == (0, 0.0)


def test_three_definitions_of_p95(spark):
    for n in (1, 2, 19, 20, 21, 100):
        df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "x double")
        linear, nearest = df.agg(stats.p95_linear("x"), stats.p95_nearest_rank("x")).first()
        assert linear == pytest.approx(np.percentile(np.arange(1, n + 1), 95)) and nearest == int(np.ceil(0.95 * n - 1e-9))
        assert stats.p95_ceil_eps(df, "x").first()[0] == min(n, int(0.95 * n + 0.999999))


def test_text_functions(spark):
    rows = spark.createDataFrame([("December 31, 2024",), ("12/31/2024",), ("20241231",), ("2024-12-31",), ("soon",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.iso_date(F.col("t"))).collect()] == ["2024-12-31"] * 4 + ["soon", None]
    one = spark.createDataFrame([("Straße  Über\n x",)], "t string").select(text.canonical(F.col("t"))).first()[0]
    assert one == "strasse über x"


def test_release_and_guard(spark, tmp_path):
    folder = str(tmp_path / "data")
    df = spark.range(5)
    with pytest.raises(ValueError, match="missing"):
        release.promote(spark, folder, {"t": df}, "r1", ["1 artifacts are missing"])
    first = release.promote(spark, folder, {"t": df}, "r1", [])
    second = release.promote(spark, folder, {"t": df.limit(2)}, "r2", [])
    now = release.current(spark, folder)
    assert first.endswith("v1") and second.endswith("v2") and (now["release_id"], now["rows"], now["version"]) == ("r2", {"t": 2}, "v2")
    assert now["digests"]["t"] == release.content(df.limit(2))[1] != release.content(df.limit(2).unionAll(df.limit(2)))[1]
    assert release.roll_back(spark, folder)["version"] == "v1" == release.current(spark, folder)["version"]
    assert sources.release_available(spark, folder) == folder
    release.Store(spark, folder).write(sources.RELEASE_MARKER, "r3")
    with pytest.raises(RuntimeError):
        sources.release_available(spark, folder)
    with pytest.raises(RuntimeError):
        release.current(spark, folder)


def test_readers(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\nnot json\n')
    assert sources.read_jsonl(spark, str(good), "a long").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_jsonl(spark, str(bad), "a long").collect()
    from pyspark.sql.types import LongType, StructField, StructType

    assert [r.line_text for r in sources.read_jsonl_errors(spark, str(bad), StructType([StructField("a", LongType())])).collect()] == ["not json"]
    files = spark.createDataFrame([("x/GM/2023-10-K.html",), ("x/GM/2024-10-K.html",), ("x/F/2022-10-K.html",), ("x/F/notes.txt",)], "path string")
    assert {(r.ticker, r.filing_year) for r in sources.newest_filings(files).collect()} == {("GM", 2024), ("F", 2022)}


def test_logical_operators(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k long, v string")
    assert {r.k: r.status for r in logical.regression(old, new, "k", "v").collect()} == {1: "removed", 2: "equal", 3: "changed", 4: "added"}
    assert {(r.k, r.v) for r in logical.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "x"), (4, "d")}
    side = logical.compose_horizontal(spark.createDataFrame([("Cash ", 1)], "label string, x int"), spark.createDataFrame([("cash", 2), ("Debt", 3)], "label string, y int"), "label")
    assert {(r.label.strip(), r.x, r.y) for r in side.collect()} == {("Cash", 1, 2), ("Debt", None, 3)}


def test_embeddings_and_rerank(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", "gamma")], "chunk_id string, text string")
    vectors = providers.embed(chunks, providers.HashingEncoder(16)).withColumn("text_sha256", F.sha2("text", 256)).drop("text").cache()
    assert audit.embedding_violations(vectors, chunks, 16).collect() == []
    stale = chunks.withColumn("text", F.concat("text", F.lit("!")))
    assert {r.rule for r in audit.embedding_violations(vectors, stale, 8).collect()} == {"stale_text", "width"}
    assert audit.manifest(vectors).first().vectors == 2
    pairs = spark.createDataFrame([(1, 7, "a b", "b c"), (1, 8, "a b", "a b")], "qid long, doc_id long, query string, text string")
    assert [(r.doc_id, r.rank) for r in providers.rerank(pairs, providers.OverlapScorer(), "doc_id", 2).orderBy("rank").collect()] == [(8, 1), (7, 2)]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    pages = ingest.file_stream(spark, str(tmp_path / "in"), "page_id long, html string")
    query = ingest.publish(ingest.block_stream(pages), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}
    folder = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(folder)
    assert ingest.latency_windows(batch).agg(F.sum("n")).first()[0] == batch.count() == ingest.sessions(batch).agg(F.sum("n")).first()[0]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_label_migration(spark):
    chunks = spark.createDataFrame(
        [("c1", ["b1", "b2"], "narrative", "The  Quick brown fox jumps.", None), ("c2", ["b2"], "narrative", "quick red fox sleeps", None), ("c3", ["b3"], "table", "x", "T1")],
        "chunk_id string, block_ids array<string>, content_type string, text string, logical_table_id string",
    )
    evidence = spark.createDataFrame(
        [(1, ["b2"], "narrative", "quick BROWN fox", None), (2, ["b3"], "table", "gone", "T1"), (3, ["b2"], "narrative", "quick red fox runs far", None), (4, ["b9"], "narrative", "x", None), (5, ["b2"], "narrative", "nothing of this kind", None)],
        "evidence_id int, block_ids array<string>, content_type string, text string, logical_table_id string",
    )
    got = {r.evidence_id: (r.chunk_id, r.method) for r in migration.match_evidence(evidence, chunks).collect()}
    assert got == {1: ("c1", "exact"), 2: ("c3", "table_identity"), 3: ("c2", "token_overlap"), 4: (None, "unresolved"), 5: (None, "unresolved")}


def test_facts_and_metadata(spark):
    page = '<ix:nonNumeric name="dei:DocumentType">10-K</ix:nonNumeric><ix:nonNumeric name="dei:EntityCentralIndexKey">0000000042</ix:nonNumeric><ix:nonNumeric name="dei:DocumentPeriodEndDate">December 31, 2024</ix:nonNumeric><ix:nonNumeric name="dei:DocumentType">10-Q</ix:nonNumeric>'
    assert html.facts(page)["documenttype"] == "10-K"
    pages = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    filings = spark.createDataFrame([(1, "AB", "42", "10-K", 2024), (2, "AB", "42", "10-K", 2023), (3, "ZZ", "1", "8-K", 2024)], "doc long, ticker string, cik string, form string, filing_year int")
    companies = spark.createDataFrame([("AB", "0000000042")], "ticker string, cik string")
    got = {(r.doc, r.rule) for r in audit.metadata_violations(filings, companies, html.filing_facts(pages)).collect()}
    assert got == {(2, "period"), (3, "unknown_company"), (3, "cik"), (3, "form")}


def test_chunking_experiments_and_group_ranks(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a b")], "doc_id long, text string")
    rows = {(r.strategy, r["size"]): r for r in chunking.experiments(docs, "doc_id", "text", [("fixed", 4, 1), ("recursive", 4, 0), ("fixed", 2, 2)]).collect()}
    assert rows["fixed", 4].chunks == 3 and rows["recursive", 4].chunks == 3 and rows["fixed", 2].feasible is False
    scores = scored(spark, [(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)])
    groups = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "doc_id long, g string")
    gold = spark.createDataFrame([(1, 3), (1, 9)], "qid long, doc_id long")
    got = [(r.doc_id, r.group_rank) for r in metrics.within_group_ranks(scores, gold, groups, "doc_id", "g").collect()]
    assert got == [(3, 2)]


def test_vectors_of_another_width_hide_no_others(spark):
    from tessera.operators import dense

    corpus = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0, 1.0], 0), (4, None, 0), (5, [0.0, 0.0], 0)], "vec_id long, embedding array<double>, label long").coalesce(1)
    queries = spark.createDataFrame([(10, [1.0, 0.1], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0, 0.0, 0.0], 0), (13, None, 0)], "qid long, embedding array<double>, label long")
    for grouped in (False, True):
        got = dense.top(queries, corpus, 5, group="label", same_group=grouped)
        assert sorted((r.qid, r["rank"], r.vec_id) for r in got.collect()) == [(10, 1, 1), (10, 2, 2), (11, 1, 3)]


def test_large_ids_and_null_ids_in_dense_search(spark):
    from tessera.operators import dense

    big = 2**53
    corpus = spark.createDataFrame([(big + 1, [1.0, 0.0]), (big + 2, [1.0, 0.1]), (None, [1.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    got = dense.top(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>"), corpus, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [big + 1, big + 2]


def test_containing_documents_equal_a_nested_loop(spark):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [(" ".join(rnd.choices(words, k=rnd.randrange(0, 60))) if i % 7 else None, i) for i in range(120)]
    passages = [(k, t[max(0, a) : a + rnd.randrange(1, 80)]) for k, (t, a) in enumerate((x, rnd.randrange(0, 40)) for x, _ in texts if x)] + [(900, None), (901, ""), (902, "w1"), (903, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    asked = spark.createDataFrame(passages + passages[:3], "qid long, passage string")
    want = {(k, i) for k, p in passages for t, i in texts if p is not None and t is not None and p in t}
    for most in (4_000_000, 0):  # as one automaton, and by runs of words
        got = [tuple(r) for r in metrics.containing(docs.unionByName(docs.limit(9)), asked, "doc_id", most_chars=most).select("qid", "doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert metrics.containing(docs, asked.filter("false"), "doc_id", most_chars=most).count() == 0
        assert metrics.containing(docs.filter("false"), asked, "doc_id", most_chars=most).count() == 0
