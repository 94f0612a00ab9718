"""Vectors, urls and the pipeline."""

import collections
import pickle
import random
import time

import numpy as np
import pytest

from cellgrove.llm import ann, queries, urls
from tests.conftest import DATA
from tests.llm.conftest import SCHEMA


def _recall(rows, got, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((ids, -np.round(score, 12)))[: min(k, len(ids) - 1)]
        found = got[int(ids[q])]
        assert [f[0] for f in found] == list(range(1, len(best) + 1))
        assert all(abs(s - x[np.flatnonzero(ids == v)[0]] @ x[q]) < 1e-9 for _, v, s in found)
        hits, total = hits + len({v for _, v, _ in found} & set(ids[best].tolist())), total + len(best)
    return hits / total


def _found(df):
    got = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_neighbours_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS h", "1 AS x")
    got = _found(ann.nearest(d, every=20, k=20))
    assert set(got) == set(range(0, 600, 20))
    assert _recall([(k, np.array(v, dtype=np.float64)) for k, v in rows], got, 20, 20) >= 0.9
    assert [v for _, v, _ in got[100]][:19] == list(range(101, 120))


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(2, 1.0), (1, 0.5)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_recall_on_the_drivers_vectors(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert _recall(rows, _found(queries.op4_ann(spark, DATA)), 20, 20) >= 0.9


def test_codes_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, size=(3000, 4), dtype=np.uint16)
    index = ann.MultiIndex(codes)
    for r in (0, 10, 20, 26):
        far = np.array([sum(bin(int(v)).count("1") for v in row) for row in codes ^ codes[7]])
        assert index.within(codes[7], r).tolist() == np.flatnonzero(far <= r).tolist()


def test_urls_against_plain_rules(spark):
    rng = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "net", "EXAMPLE.Org", "org."]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12/3", "/en/2", "/fr/", "/de/x", "/de"]
    rows = [(k, f"http{'s' * (k % 2)}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#/de/'])}") for k in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme.org/"), (903, "x://y://z/")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule"), queries.URL_RULES)
    for r in out.collect():
        fit = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fit, default=None)
        assert (r["rule"], r["verdict"]) == ((best[1], "allow" if best[2] else "block") if best else (None, "allow"))
    by = {r["page_id"]: (r["host"], r["path"]) for r in out.collect()}
    assert by[900] == by[901] == by[902] == ("", "") and by[903] == ("y:", "//z/")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.Trie([("org", "x", True)])


def test_many_rules_are_joined(spark):
    rng = random.Random(3)
    hosts, parts = ["a.org", "org", "b.a.org", "com", "x.com"], ["", "e", "en", "en1", "é", "f"]
    path = lambda n: "/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    rules = [(rng.choice(hosts), path(3), rng.random() < 0.5) for _ in range(60)]
    rows = [(k, f"h://{rng.choice([*hosts, 'c.b.a.org', 'net'])}{path(4)}") for k in range(500)] + [(7, None), (None, "h://org"), (3, "h://org/e")] * 2
    d = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS rid", "2 AS Rule")
    key = lambda r: repr(tuple(r))
    sent, joined = urls.judge(d, rules).collect(), urls.judge(d, rules, most_bytes=0).collect()
    assert sorted(map(tuple, sent), key=key) == sorted(map(tuple, joined), key=key) and len(sent) == len(rows)
    assert urls.judge(d.limit(0), rules, most_bytes=0).count() == 0


def test_long_urls_are_linear():
    trie = urls.Trie([("org", "/" + "a/" * 3000, True), ("org", "/" + "b" * 5000, False)])
    began = time.time()
    assert trie.judge("org", "/" + "b" * 2_000_000)[1] is False and trie.judge("org", "/" + "a/" * 500_000)[1] is True
    assert time.time() - began < 2
    assert pickle.loads(pickle.dumps(trie)).judge("x.org", "/" + "a/" * 3000)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, spark, sql, rows_of):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == sql(queries.ORACLE_SQL[name])


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    for given in (docs, none):
        kept = given
        for name, stage in c.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, sf)
            assert kept.columns == given.columns, name
        assert kept.count() <= before.count()
        assert c.STAGES[-1][1](spark, kept, sf).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    first = c.quality_rules(spark, docs, sf)
    assert first.where("doc_id IN (0, 1, 3, 14)").count() == 0 and first.where("doc_id IN (6, 7, 8, 27)").count() == 5
    second = c.near_duplicates(spark, docs, sf)
    assert second.where("doc_id IN (7, 8) OR doc_id IS NULL").count() == 1
    spark.createDataFrame(docs.rdd, SCHEMA).drop("rid", "v", "found", "at", "label").write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, sf).count() > 0
