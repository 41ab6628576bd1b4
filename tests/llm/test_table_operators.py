"""Url filter, exact search, sharding and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from summitry.llm import common, pivotsearch, sharding, urlfilter

# urls


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:stop]


def plain_rule(host, path):
    best = None
    for rule, verdict in urlfilter.RULES:
        domain, tail = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q#f", "http://example.net/EN/", "http://notnet/", "http://net/", "http://net", "x://b.net?x=/en/",
    "http://a.example.com/de/1", "http://example.com/de", "http://foo.org/fr/", "http://casinowin.example.com/a://b", "http://Été.org/fr/ü#/", "ftp://h:80/p/q#r?s", "http://a.b\nc/de/",
    "http://www.cheappillsonline.com/buy-now/" + "9" * 5000, "http://sciencejournal.example.com/", "http://" + "a" * 3000 + ".com/",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, verdict string")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = plain_parts(URLS[r.page_id % len(URLS)])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else "block" if r.score > 0.5 else "allow")
    by = {URLS[r.page_id % len(URLS)]: r for r in rows}
    assert by[URLS[17]].verdict == "block" and by[URLS[13]].verdict == "block" and by[URLS[18]].verdict == "allow" and by[None].score == 0.5
    assert by[URLS[13]].words.startswith("casino win")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_segmentation_is_the_likeliest():
    s = urlfilter.Segmenter({"a": 5, "ab": 3, "abc": 1, "b": 2, "cd": 4, "d": 1})

    def cost(words):
        return sum(s.cost.get(w, s.unknown + s.letter * len(w)) for w in words)

    def splits(x):
        return [[]] if not x else [[x[:i], *rest] for i in range(1, len(x) + 1) for rest in splits(x[i:])]

    for name in ("abcd", "aabcd", "zzab", "dcba", "abzcd"):
        assert cost(s.split(name)) == pytest.approx(min(map(cost, splits(name))))


# search


def plain_search(rows, k, every):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % every == 0:
            pad = lambda x: np.pad(x, (0, 80 - len(x)))
            best = sorted((-int(pad(v) @ pad(x)), i) for i, x in ok if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_search_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf_dir, "embeddings").collect()]
    got = {tuple(r)[:4] for r in entry.queries()["op4_pivot_topk"](spark, sf_dir).collect()}
    assert got == plain_search(rows, 20, 20)


def test_search_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(pivotsearch, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(pivotsearch, "QUERY_BLOCK", 4)
    monkeypatch.setattr(pivotsearch, "STEP", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(200)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None, 2.0]), (303, [float("nan")] * 3), (304, [float("inf"), 0.0, 0.0]), (305, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {tuple(r)[:4] for r in pivotsearch.top_k(df, 6, 20).collect()}
    assert got == plain_search(rows, 6, 20)
    few = df.where("vec_id < 4")
    assert pivotsearch.top_k(few, 20, 20).count() == 3 and pivotsearch.top_k(df.limit(0), 5, 20).count() == 0


def test_search_of_large_components(spark):
    rows = [(i, [1e8 * (i % 7), 3e8 - i, 5.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in pivotsearch.top_k(df.withColumn("embedding", F.transform("embedding", lambda x: x / 64)), 5, 20).collect()}
    exact = {q: sorted((-sum(int(np.floor(64 * (a / 64))) * int(np.floor(64 * (b / 64))) for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:5] for q in (0, 20, 40)}
    assert got == {(q, r, i) for q, best in exact.items() for r, (_, i) in enumerate(best, 1)}


def test_search_of_repeated_ids(spark):
    """Rows that share an id are queries of their own and candidates of each other."""
    rng = np.random.default_rng(4)
    rows = [(i % 25, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r)[:4] for r in pivotsearch.top_k(df, 4, 20).collect())
    whole = [[int(np.floor(64 * x)) for x in v] for _, v in rows]
    want = Counter()
    for a, (q, _) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(whole[a], whole[b])), i, b) for b, (i, _) in enumerate(rows) if b != a)[:4]
            want.update((q, r, i, -s) for r, (s, i, _) in enumerate(best, 1))
    assert got == want


def test_search_stops_early_where_pivots_tell(spark):
    """In few dimensions most candidates are never evaluated."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2) * 9]) for i in range(6000)], "vec_id long, embedding array<double>")
    seen = pivotsearch.top_k(df, 5, 50).groupBy("query_id").agg(F.max("evaluated").alias("n")).agg(F.avg("n")).first()[0]
    assert seen < 2500


def test_search_excludes_in_many_dimensions(spark):
    """Most candidates are left out in as many dimensions as the table has, and the result is still whole."""
    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(10, 64))
    v = kinds[rng.integers(10, size=6000)] * 0.4 + rng.normal(size=(6000, 64))
    rows = [(i, [float(x) for x in u]) for i, u in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    found = pivotsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 100).collect()
    assert {tuple(r)[:4] for r in found} == plain_search(rows, 20, 100)
    assert np.mean([r.evaluated for r in found]) < 1500


def test_search_in_blocks_of_wide_vectors(spark, monkeypatch):
    """Rows are copied to few blocks, blocks hold bounded numbers, and however they fall the result is the same."""
    n_cand, n_query = pivotsearch.blocks(1_000_000, 50_000, 64)
    assert 1_000_000 * n_query + 50_000 * n_cand < 4_000_000
    assert all(n / b * 4096 <= pivotsearch.BLOCK_NUMBERS for n, b in zip((1_000_000, 50_000), pivotsearch.blocks(1_000_000, 50_000, 4096)))
    monkeypatch.setattr(pivotsearch, "BLOCK_NUMBERS", 2000)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=(40, 25, 3)[i % 3])]) for i in range(150)]
    rows += [(150 + i, rows[i][1]) for i in range(30)]
    got = [tuple(r)[:4] for r in pivotsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 7, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_search(rows, 7, 5)


@pytest.mark.parametrize("width", [1, 2, 3, 64, 200])
def test_bounds_hold_for_odd_vectors(width):
    """No bound is under its inner product: unlike lengths, multiples, zeros, copies, numbers beyond 24 and 53 bits."""
    rng = np.random.default_rng(width)
    v = np.floor(rng.normal(size=(120, width)) * 50)
    v = np.r_[v, v[:9] * 3, -v[:9], v[:9], np.zeros((2, width)), v[:20] * 2.0**30, v[20:40] * 2.0**55, np.eye(width)[:5]]
    for pivots in (1, 2, 64):
        table = pivotsearch.apexes(v, pivotsearch.frame(pivotsearch.choose_pivots(v[::2], pivots)))
        bounds = pivotsearch.upper_bounds(table, table)
        assert np.isfinite(bounds).all()
        whole = v.astype(object)
        for i in range(len(v)):
            assert all(int(sum(int(a) * int(b) for a, b in zip(whole[i], w))) <= float(b_) for w, b_ in zip(whole, bounds[i]))


@pytest.mark.parametrize("scale", [1, 2.0**20, 2.0**40])
def test_walk_keeps_all_equal_scores(monkeypatch, scale):
    """Of equal scores the first places win, however large the numbers are and however the steps fall."""
    monkeypatch.setattr(pivotsearch, "STEP", 7)
    rng = np.random.default_rng(5)
    v = np.floor(rng.integers(-2, 3, size=(300, 3)) * scale)
    basis = pivotsearch.frame(pivotsearch.choose_pivots(v, 2))
    table, products = pivotsearch.apexes(v, basis), pivotsearch._Products(v, v)
    for i in range(0, 300, 10):
        bounds = pivotsearch.upper_bounds(table[i : i + 1], table)[0]
        bounds[i] = -np.inf
        places, scores, _ = pivotsearch.walk(i, bounds, products, 20)
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], w)), j) for j, w in enumerate(v) if j != i)[:20]
        assert list(zip((-int(s) for s in scores), places.tolist())) == exact


# shards


def test_shards_of_null_and_repeated_records(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = sharding.shard_records(docs, 8, 512).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.02


def test_shards(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = entry.queries()["op10_virtual_slots"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    load, places = Counter(), {}
    for r in rows:
        load[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_map_is_edited_not_rebuilt(spark, tmp_path):
    rng = np.random.default_rng(1)
    sums = {s: int(b) for s, b in enumerate(rng.integers(100, 2000, 1024))}
    first = sharding.build_map(sums, 8, 1024)
    grown = sharding.edit_map(first, sums, 9)
    load = Counter()
    for s, shard in enumerate(grown):
        load[shard] += sums[s]
    moved = [s for s in range(1024) if first[s] != grown[s]]
    assert max(load.values()) / min(load.values()) < 1.05 and sum(sums[s] for s in moved) <= 1.2 * sum(sums.values()) / 9
    assert sharding.edit_map(grown, sums, 9) == grown
    assert set(sharding.edit_map(grown, sums, 7)) == set(range(7))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    store = f"file://{tmp_path}/maps"
    sharding.shard_records(docs, 4, 256, store, 1).collect()
    sharding.shard_records(docs, 5, 256, store, 2).collect()
    a, b = (spark.read.parquet(f"{store}/version={v}").orderBy("virtual_slot").collect() for v in (1, 2))
    assert len(a) == len(b) == 256 and 0 < sum(x.shard != y.shard for x, y in zip(a, b)) < 160


def test_shard_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 100_000), (None, "x"), (4, "y"), (4, "y"), (4, "z")], "doc_id long, text string").withColumn("size", F.lit("mine")).withColumn("slot", F.lit(3))
    rows = sharding.shard_records(df, 3, 64).collect()
    assert len(rows) == 7 and {r["size"] for r in rows if r.doc_id in (1, 2)} == {16} and {r["size"] for r in rows if r.doc_id == 3} == {200_016}
    assert sharding.shard_records(df.limit(0), 3, 64).count() == 0


# pipeline


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "decontamination", "pieces"]
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "stages")
    now, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.save(stage(spark, now, sf_dir), name)
        left = {r.doc_id for r in now.select("doc_id").collect()}
        assert now.columns == docs.columns and left <= ids and len(left) > 0.6 * docs.count()
        ids = left
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == ids
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in last.collect())


def test_pipeline_over_odd_rows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(0)
    more = spark.createDataFrame([(0, None, None, None, None), (1, "", "en", "s", 0), (2, "die und der " * 50_000, "de", "s", 5), (None, "the the", "en", "s", 3), (2, "die und der " * 50_000, "de", "s", 5)], docs.schema)
    more = more.withColumn("score", F.lit("mine")).withColumn("key", F.lit(1))
    for df in (docs, more):
        first = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            # columns as they came; rows that repeat id and text stay or go together
            assert df.columns == first.columns and df.where("doc_id = 2").count() in (0, 2)
            assert df.exceptAll(first).isEmpty()
        last = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
        assert last.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
