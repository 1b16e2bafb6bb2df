import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, spiece, warc


@pytest.fixture(scope="module")
def trie():
    return spiece.Trie(spiece.vocabulary(), 1.0)


def paths(trie, text):
    """Every segmentation of one word (with its leading space) and its weight, by plain enumeration."""
    pieces_ = {raw: i for i, raw, rank in spiece.vocabulary() if rank >= 0}
    raw = b" " + text.encode()

    def go(at):
        if at == len(raw):
            yield ()
        for end in range(at + 1, len(raw) + 1):
            if raw[at:end] in pieces_:
                for rest in go(end):
                    yield (pieces_[raw[at:end]], *rest)

    found = {p: float(np.exp(trie.weight[list(p)].sum())) for p in go(0)}
    total = sum(found.values())
    return {p: w / total for p, w in found.items()}


def draws(trie, texts, keys, k):
    data = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = {}
    for t, _, ids, logp, inclusion, _ in spiece._sampled(data, trie, k, 7):
        out.setdefault(t, []).append((tuple(ids.tolist()), logp, inclusion))
    return out


def test_samples_are_distinct_and_follow_the_distribution(trie):
    want = paths(trie, "then")
    n = 4000
    got = draws(trie, ["then"] * n, list(range(n)), 3)
    pairs = {}
    for samples in got.values():
        assert len({s for s, _, _ in samples}) == 3
        for s, logp, inclusion in samples:
            assert logp == pytest.approx(np.log(want[s]), abs=1e-9) and inclusion <= 0
        first = samples[0][0]
        pairs[first, samples[1][0]] = pairs.get((first, samples[1][0]), 0) + 1
    for a, b in itertools.permutations(want, 2):  # without replacement: p(a) p(b) / (1 - p(a))
        p = want[a] * want[b] / (1 - want[a])
        assert abs(pairs.get((a, b), 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    # inclusion scores weigh samples so that every segmentation counts once on average
    weight = {s: 0.0 for s in want}
    for samples in draws(trie, ["then"] * n, list(range(n)), 2).values():
        for s, logp, inclusion in samples:
            weight[s] += np.exp(logp - inclusion) / n
    for s, p in want.items():
        if p > 0.01:
            assert weight[s] == pytest.approx(p, rel=0.25)


def test_all_segmentations_in_the_end(trie):
    want = paths(trie, "at")
    got = draws(trie, ["at"], [1], 50)[0]
    assert {s for s, _, _ in got} == set(want) and all(i == 0 for _, _, i in got)


@pytest.mark.parametrize("text", ["  a", "a   b", "  ", "a  "])
def test_runs_of_spaces_are_pieces(trie, text):
    want = paths(trie, text)
    assert any(b"  " in trie.raw[trie.start[i] : trie.start[i] + trie.size[i]].tobytes() for p in want for i in p)
    for texts in ([text], [text, "  x", text, " ", "   "]):  # units of spaces alone beside others
        got = draws(trie, texts, [1] * len(texts), len(want) + 5)[0]
        assert {s for s, _, _ in got} == set(want) and len(got) == len(want)
        assert all(logp == pytest.approx(np.log(want[s]), abs=1e-9) for s, logp, _ in got)


def test_round_trip_and_partition_independence(spark, trie):
    texts = ["Hello  world\n\tand\r\n more", "", None, " ", "▁x ▁", "\x00ÿ漢字𝄞é́", "a" * 5000, "word " * 20_000, "Ünïcödé ñandú", "- - -"]
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)] + [(None, "the same", None, None), (3, "the same", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample string, ids array<int>")
    one = spiece.segmentations(docs.coalesce(1), k=3).collect()
    many = spiece.segmentations(docs.repartition(6), k=3).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert all(r.round_trip for r in one)
    back = spiece.decoded(spiece.segmentations(docs.filter("doc_id < 3 OR doc_id > 3"), k=2)).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    keyed = {}
    for r in one:
        keyed.setdefault(r.doc_id, []).append(r)
    assert [r.ids for r in keyed[1]] == [[]] and [r.ids for r in keyed[2]] == [[]]
    assert len({tuple(r.ids) for r in keyed[7]}) == 3
    dig = spiece.segmentations(docs, k=1, digests=True).filter("doc_id = 0").first()
    assert dig.text_sha256 == hashlib.sha256(texts[0].encode()).hexdigest() and dig.round_trip
    assert spiece.segmentations(docs.limit(0)).collect() == []


def test_quality_learns_tables_and_pairs(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(3, 60)))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" if i % 2 else w + "%%%" for w in words), f"s{i % 4}", 0.5))
        labels.append((i, int(good) if i % 50 else None))
    rows += [(5000, None, "s", 0.0), (5001, "", "s", 0.0), (5002, "x " * 100_000, "s", 0.0), (None, "some words here.", "s", 0.0), (0, rows[0][1], "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score_ double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks.filter("doc_id % 5 <> 0"))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    same = quality.score(docs.repartition(5), quality.fit(docs.repartition(2), marks.filter("doc_id % 5 <> 0"))).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(r.doc_id), round(r.score, 9)) for r in same)
    assert {r.score for r in quality.score(docs, quality.fit(docs, marks.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_features_by_hand():
    x = dict(zip(quality.FEATURES, quality.features(pa.array(["Ab cd.\nab!! ab!!\nAb cd."]))[0]))
    assert x["log_words"] == pytest.approx(np.log1p(6)) and x["distinct_words"] == pytest.approx(3 / 6)  # ab, cd., ab!!
    assert x["repeated_lines"] == pytest.approx(1 / 3) and x["top_word"] == pytest.approx(2 / 6)


def plain_tree(g, h, leaves=3, l2=1.0, least=0.25):
    """Best-first splits of ordered bins, every cut tried by plain sums."""
    cuts = [0, len(g)]
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + l2)
    for _ in range(leaves - 1):
        tried = [(gain(a, m) + gain(m, b) - gain(a, b), -m) for a, b in zip(cuts, cuts[1:]) for m in range(a + 1, b) if sum(h[a:m]) >= least and sum(h[m:b]) >= least]
        if not tried or max(tried)[0] <= 1e-6:
            break
        cuts = sorted([*cuts, -max(tried)[1]])
    return [sum(g[a:b]) / (sum(h[a:b]) + l2) for a, b in zip(cuts, cuts[1:]) for _ in range(a, b)]


def test_shallow_trees_equal_plain_search():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 9, 30):
        for _ in range(10):
            g, h = rng.normal(size=n), rng.random(n) * rng.choice([0.05, 1.0])
            assert quality._tree(g, h) == pytest.approx(plain_tree(g.tolist(), h.tolist()))
    for shape in ((2, 2), (3, 5), (8, 8)):
        g, h = rng.normal(size=shape), rng.random(shape)
        parts = lambda r, c: [(slice(0, r), slice(0, c)), (slice(0, r), slice(c, None)), (slice(r, None), slice(0, c)), (slice(r, None), slice(c, None))]
        gains = {(r, c): sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts(r, c)) for r in range(1, shape[0]) for c in range(1, shape[1])}
        cut = max(gains, key=gains.get)
        want = np.empty(shape)
        for p in parts(*cut):
            want[p] = g[p].sum() / (h[p].sum() + 1)
        found, gain = quality._tree2(g, h)
        assert found == pytest.approx(want) and gain == pytest.approx(gains[cut] - g.sum() ** 2 / (h.sum() + 1))


def test_boosting_equals_a_plain_model():
    """Cyclic rounds of shallow trees a feature, then a pair, kept at the best held-out round: all by plain loops."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(240, 3)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (rng.random(240) < 0.1)).astype(float)
    model = quality.Model(x, y, rounds=6, rate=0.3, pairs=1, patience=3)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]))) for f in range(3)]
    coarse = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.COARSE + 1)[1:-1]))) for f in range(3)]
    bin_of = lambda c, v: sum(v >= e for e in c)
    part = np.random.default_rng(5).permutation(240).tolist()
    hold, fit = part[:40], part[40:]
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    f = [base] * 240
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    loss = lambda: np.mean([np.logaddexp(0, -f[i] * (2 * y[i] - 1)) for i in hold])

    def boost(cells, sizes, tree):
        tables = [[0.0] * n for n in sizes]
        best, since, kept = loss(), 0, [list(t) for t in tables]
        for _ in range(6):
            for t, cell in zip(tables, cells):
                g, h = [0.0] * len(t), [0.0] * len(t)
                for i in fit:
                    p = sigmoid(f[i])
                    g[cell[i]] += y[i] - p
                    h[cell[i]] += p * (1 - p)
                add = [0.3 * v for v in tree(g, h)]
                for k, v in enumerate(add):
                    t[k] += v
                for i in range(240):
                    f[i] += add[cell[i]]
            now, since = loss(), since + 1
            if now < best - 1e-5:
                best, since, kept = now, 0, [list(t) for t in tables]
            if since >= 3:
                break
        for t, k, cell in zip(tables, kept, cells):
            for i in range(240):
                f[i] += k[cell[i]] - t[cell[i]]
        return kept

    cells = [[bin_of(cuts[k], v) for v in x[:, k]] for k in range(3)]
    tables = boost(cells, [len(c) + 1 for c in cuts], plain_tree)
    (a, b, table), = model.pairs
    assert (a, b) == (0, 1)  # the planted interaction
    wide = len(coarse[b]) + 1
    joint = [bin_of(coarse[a], u) * wide + bin_of(coarse[b], v) for u, v in zip(x[:, a], x[:, b])]
    cross = lambda g, h: quality._tree2(np.reshape(g, (-1, wide)), np.reshape(h, (-1, wide)))[0].ravel()
    pair, = boost([joint], [(len(coarse[a]) + 1) * wide], cross)
    for t, want in zip(model.tables, tables):
        assert t == pytest.approx(want)
    assert table.ravel() == pytest.approx(pair)
    total = [base + sum(t[c[i]] for t, c in zip(tables, cells)) + pair[joint[i]] for i in range(240)]
    assert model.score(x) == pytest.approx([sigmoid(v) for v in total])


def test_fit_takes_labels_from_the_labels_only(spark):
    """Columns named like the operator's own, in both tables, change nothing."""
    rows = [(i, ("plain words here." if i % 2 else "BAD!! %%%"), i, 1 - i % 2, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, y int, x long")
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2, 7) for i in range(200)], "doc_id long, quality int, y int, id int")
    plain = quality.fit(docs.select("doc_id", "text"), marks.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, marks)).collect()}
    want = {r.doc_id: r.score for r in quality.score(docs, plain).collect()}
    assert got == want and got[1] > 0.9 > 0.1 > got[0]


def page_rows():
    rows = [(i, f"https://{'hot' if i % 2 else f'h{i % 17}'}.example.com/p/{i % 40}?q={i % 3}#f", f"<p>{i % 25}</p>") for i in range(400)]
    rows += [(900, None, None), (901, "no scheme", ""), (902, "http://x.org/\r\nX: 1", "é" * 200_000), (903, "http://x.org", "é" * 200_000), (None, "http://n.org/", "<p>1</p>"), (399, rows[399][1], rows[399][2])]
    return rows


@pytest.mark.parametrize("min_bytes,small", [(0, False), (9, True)])
def test_archives_read_back(spark, monkeypatch, min_bytes, small):
    if small:  # the paths for many repeated payloads, and many blocks
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(warc, "HOT_SHARE", 30)
        monkeypatch.setattr(warc.write_index, "__defaults__", (7,))
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.archive(pages, min_bytes=min_bytes).collect()), key=str)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        group = [j for j, _, x in rows if (x or "") == (h or "") and j is not None] if len(raw) >= min_bytes else []
        repeated = len(raw) >= min_bytes and sum((x or "") == (h or "") for _, _, x in rows) > 1
        keep = max(group) if repeated and group else i
        line = u.replace("\r", "%0D").replace("\n", "%0A") if u is not None else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if keep == i else "revisit", None if keep == i else keep, line))
    assert got == sorted(want, key=str)


def test_lookup_of_single_captures_and_empty_tables(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    folder = warc.scratch(spark, "t")
    manifest = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=5)
    assert manifest.agg({"blocks": "sum"}).first()[0] > 20
    wanted = pages.filter("page_id IN (7, 901)").unionByName(spark.createDataFrame([(1, "http://nowhere.org/", "")], pages.schema))
    got = {r.page_id: r for r in warc.lookup(wanted, manifest).collect()}
    assert set(got) == {7, 901} and got[7].url == "https://hot.example.com/p/7?q=1#f"
    assert warc.archive(pages.limit(0)).collect() == []


def test_very_many_captures_of_one_key_are_read_file_by_file(spark, monkeypatch):
    monkeypatch.setattr(warc, "BATCH_BYTES", 3000)
    rows = [(None, None, f"payload {i} " * 20) for i in range(400)] + [(i, f"http://h{i}.org/", f"other {i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    folder = warc.scratch(spark, "hot")
    manifest = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=16)
    assert manifest.filter("first_key = ''").count() > 1  # the hot key spans index files
    read = warc.lookup(pages.select("url", "page_id"), manifest)
    tasks = read.filter("page_id IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 400
    assert sorted((str(r.page_id), r.payload.decode()) for r in read.collect()) == sorted((str(i), h) for i, _, h in rows)


def test_reversed_host_keys():
    assert warc.reversed_host("HTTP://www.Example.com/A?b#c") == "com,example,www)/A?b"
    assert warc.reversed_host("http://a.b?x/y") == "b,a)?x/y" and warc.reversed_host(None) == "" and warc.reversed_host("x") == ""


def test_taken_column_names(spark):
    docs = spark.createDataFrame([(1, "some text here", 2.0, "x", "y", "z")], "doc_id long, text string, score double, lang_pred string, gone_id string, digest string")
    from tessera.llm import exactdup, langid, neardup

    model = quality.fit(docs, docs.select("doc_id").limit(0).selectExpr("doc_id", "1 AS quality"))
    assert quality.score(docs, model).columns == [*docs.columns, "score_"]
    trained = langid.fit(docs.selectExpr("text", "'en' AS lang"))
    assert langid.predict(docs, trained).columns == [*docs.columns, "lang_pred_", "score_", "bits"]
    for kept in (exactdup.distinct_documents(docs), neardup.distinct_documents(docs)):
        assert kept.columns == docs.columns and kept.count() == 1
    pages = spark.createDataFrame([(1, "http://a.b/", "h", "w", "d")], "page_id long, url string, html string, winner string, digest string")
    assert warc.archive(pages).first().record_type == "response"
    ids = spiece.segmentations(docs, k=1).withColumnRenamed("doc_id", "text")
    assert spiece.decoded(ids).first().text_ == "some text here"
