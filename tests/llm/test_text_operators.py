"""Small cases of the operators on texts, against brute force or exact round trips."""

import collections
import json
from collections import Counter
import random
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from summitry.llm import bpe, bytesops, common, decontaminate, jaccardjoin, langid, pieces, tokencount, tokenfile, toxicity
from summitry.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty, very long, tied and repeated rows, and a clashing extra column."""
    texts = [None, "", " ", "one", "a b c d e f g", "a b c d e f g", "ünïcode 漢字 🙂 words and words", "12 345 !!", "x" * 300_000, "the cat " * 30_000]
    df = documents(spark, texts)
    return df.unionByName(df.where("doc_id in (4, 7)")).withColumn("score", F.lit("mine")).withColumn("n_tokens", F.lit(1))


# bytes


def test_words_and_hashes():
    texts = [b"", b" Aa\tb ", b"aa b", b"x\x0by"]
    w = bytesops.Words(texts)
    assert [texts[0:4] and bytes(w.data[s:e]) for s, e in zip(w.start, w.end)] == [b"Aa", b"b", b"aa", b"b", b"x", b"y"]
    assert w.doc.tolist() == [1, 1, 2, 2, 3, 3] and w.hash[0] == w.hash[2] and w.hash[0] != w.hash[1]
    assert len(bytesops.shingle_hashes(w.hash[:0])) == 0 and len(bytesops.shingle_hashes(w.hash[:3])) == 1
    assert list(bytesops.blocks([b"x" * 10] * 5, 20)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_long_block_hash_is_position_free():
    a = bytesops.Words([b"pad " * 600_000 + b"word"]).hash[-1]
    assert a == bytesops.Words([b"word"]).hash[0]


# language id


def test_gradients_are_right():
    net = langid.Network(["a", "b"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    windows = rng.integers(97, 105, (6, 4)).astype(np.uint8)
    target = np.array([0, 1, 0, 1])
    _, g = net.gradients(windows, target)
    for name, at in (("uf", (1, 2)), ("ub", (7, 0)), ("xf", (8, 99)), ("xb", (2, 101)), ("o", (1, 3)), ("c", (0, 0))):
        was = net.w[name][at]
        loss = []
        for step in (1e-3, -1e-3):
            net.w[name][at] = was + step
            loss.append(net.gradients(windows, target)[0])
        net.w[name][at] = was
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(g[name][at], rel=0.05, abs=2e-4)


def test_language_of_held_out_rows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = entry.queries()["op1_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang_pred == r.lang for r in found) / len(found) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    df = documents(spark, ["the cat sat on the mat " * 5] * 20, "en").unionByName(documents(spark, ["der hund und die katze " * 5] * 20, "de").withColumn("doc_id", F.col("doc_id") + 100))
    net = langid.train(df)
    rows = {r.doc_id: r for r in langid.predict(odd(spark), net).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4 and rows[9].lang_pred == "en"
    kept = langid.keep_identified(odd(spark), net)
    assert kept.columns == odd(spark).columns and kept.where("doc_id in (0, 1, 2, 7)").count() == 0
    assert langid.predict(df.limit(0), net).count() == 0
    nobody = langid.train(df.limit(0))
    assert langid.predict(df, nobody).select("lang_pred", "score").distinct().collect() == [("und", 0.0)]


# pieces


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice.at(pieces.default_path(), 3)


def all_segmentations(lattice, text):
    s, out = pieces.BLANK + text.replace(" ", pieces.BLANK), []

    def go(i, score):
        if i == len(s):
            out.append(score)
            return
        for e in range(i + 1, min(len(s), i + 16) + 1):
            piece = lattice.vocabulary.get(s[i:e])
            if piece:
                go(e, score + piece[1])
            elif e == i + 1:
                go(e, score + lattice.unknown_score)

    go(0, 0)
    return sorted(out, reverse=True)


def test_n_best_against_all(lattice):
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice("the ing onéa,#\n漢") for _ in range(rng.randint(1, 11)))
        found = lattice.encode(text)
        assert [s for s, _ in found] == all_segmentations(lattice, text)[:3]
        assert len({ids for _, ids in found}) == len(found) and all(lattice.decode(ids) == text for _, ids in found)


def test_pieces_edge_cases(spark, lattice):
    assert lattice.encode("") == [(0, b"")] and lattice.decode(b"") == ""
    assert lattice.decode(lattice.encode("aaaa" * 5000)[2][1]) == "aaaa" * 5000
    rows = pieces.digests(odd(spark)).collect()
    assert all(r.decodes for r in rows) and {r.doc_id for r in rows} == set(range(10))
    whole = pieces.segmentations(odd(spark).where("doc_id = 4"), 2).orderBy("rank").collect()
    assert [r["rank"] for r in whole] == [1, 1, 2, 2] and lattice.decode(np.array(whole[0].ids)) == "a b c d e f g"
    assert pieces.digests(odd(spark).limit(0)).count() == 0


# byte-pair ids


def test_ids_are_the_librarys(spark):
    rng = random.Random(3)
    parts = [*"abTheé ñ's 12²\n\n\t  .,!#漢\x1c\x85\xa0 ", "<|endoftext|>", "  ", "   ", " \n", "ing ", "'ll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    encoder = bpe.WordEncoder(bpe.default_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and encoder.count(texts) == [len(w) // 4 for w in want]


def test_known_parts_are_not_encoded_again(monkeypatch):
    encoder, words = bpe.WordEncoder(bpe.default_path()), []
    word = encoder._word
    monkeypatch.setattr(encoder, "_word", lambda w: words.append(w) or word(w))
    texts = ["a wordy", "a wordy, wordy."]
    assert [encoder.encode([t])[0] for t in texts] == [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words == ["a", ",", "."]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    encoder = bpe.WordEncoder(bpe.default_path())
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_a_part_is_looked_up_once_in_a_block():
    """However often it occurs; lookups of each occurrence took op9 beyond its CPU budget."""

    class Counted(dict):
        lookups = 0

        def get(self, *key):
            Counted.lookups += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.lookups += 1
            return super().__getitem__(key)

    encoder = bpe.WordEncoder(bpe.default_path())
    encoder.parts = Counted()
    texts = ["first words, éü of\nlines. " + "the cat's 12 " * 1000 + "end"] * 20
    want = np.array(encoder.library.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(texts) == [want] * 20 and Counted.lookups < 100
    assert encoder.count(texts) == [len(want) // 4] * 20 and Counted.lookups < 100


def test_words_of_texts_without_single_blanks_are_not_kept_for_ever(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    for texts in ([f"a{i}  b{i}  c{i}" for i in range(300)], [f"w{i}x" for i in range(300)]):
        encoder = bpe.WordEncoder(bpe.default_path())
        for text in texts:
            encoder.encode([text])
        assert len(encoder.known) + len(encoder.parts) + len(encoder.older) < 200


def test_blocks_and_turns_of_memory_keep_the_ids(monkeypatch):
    """Texts of few and many parts, with and without blanks, among such that the library encodes whole."""
    rng = random.Random(4)
    words = ["the", "éü", "ÿx", "a.\nBe", "x\n\n", "'s", "don't", "12a", "²", "ª", "\x00", "&&&", "ing,", "<|endoftext|>", "漢", "\xa0", ""]
    texts = [" ".join(rng.choice(words if rng.random() < 0.2 else words[:13]) + rng.choice(("", "", str(i))) for _ in range(rng.randint(0, 12))) for i in range(2000)]
    monkeypatch.setattr(bpe, "MEMORY", 40)
    for block in (1, 100, 1 << 20):
        monkeypatch.setattr(bpe, "BLOCK", block, raising=False)
        encoder = bpe.WordEncoder(bpe.default_path())
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == want and encoder.count(texts[::-1]) == [len(w) // 4 for w in want[::-1]]


def test_token_counts_use_the_cache(spark, tmp_path):
    docs, cache = odd(spark), str(tmp_path / "cache")
    first = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs, cache).collect()}
    count = lambda: spark.read.parquet(cache).select("digest").distinct().count()
    stored = count()
    assert stored == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = tokencount.token_counts(docs.unionByName(documents(spark, ["new one"]).withColumn("score", F.lit("")).withColumn("n_tokens", F.lit(0))), cache)
    assert again.count() == docs.count() + 1 and count() == stored + 1
    encoder = bpe.WordEncoder(bpe.default_path())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert first == {(i, len(t.encode()), n := len(encoder.library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}
    assert tokencount.token_counts(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_each_text_is_encoded_once(spark, tmp_path):
    """Copies under other ids, the same id and null ids: one row of the cache for each text."""
    rows = [(None, "one text")] * 50 + [(i, "one text") for i in range(20)] + [(5, "one text")] * 10 + [(5, "another"), (6, "another"), (None, None), (7, ""), (8, "third")]
    cache = str(tmp_path / "cache")
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cache)
    assert got.count() == len(rows) and got.groupBy("n_bytes").count().count() == 4
    assert spark.read.parquet(cache).count() == 4


def test_token_files(spark, tmp_path):
    docs = odd(spark).repartition(3)
    uri = f"file://{tmp_path}/tokens"
    tokenfile.write_token_files(docs, uri)
    rows = sorted(tuple(r) for r in tokenfile.read_token_files(spark, uri).collect())
    encoder = bpe.WordEncoder(bpe.default_path())
    start, want = 0, []
    for r in sorted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()):
        ids = np.array([*encoder.library.encode(r.t, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows == sorted(want)
    files = tokenfile.TokenFiles(uri)
    assert len(files) == len(want) and files[0][1].tolist() == [2] and files[len(want) - 1][0] == 9
    assert json.load(open(tmp_path / "tokens" / "manifest.json"))["end_id"] == 2
    tokenfile.write_token_files(docs.limit(0), f"file://{tmp_path}/none")
    assert tokenfile.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        tokenfile._folder("hdfs://far/away")


# near duplicates


def word_sets(rows):
    out = {}
    for r in rows:
        x = "".join(c.lower() if "A" <= c <= "Z" else c for c in (r.text or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        out.setdefault(r.doc_id, set()).update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join_on_the_table(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op7_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute_components(word_sets(rows))


def test_jaccard_join_with_common_passages_and_chains(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    passage, base = words(60), words(80)
    texts = [" ".join(words(rng.randint(5, 60)) + passage) for _ in range(40)]
    chain = list(base)
    for k in range(12):  # each a near copy of the one before it only
        chain = chain[1:] + words(1) if k % 2 else chain[:40] + words(1) + chain[41:]
        texts.append(" ".join(chain))
    texts += [" ".join(base[:n]) for n in range(1, 12)] + ["a b c", "A B  c", "", None]
    df = documents(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.link_components(df).collect()}
    assert got == brute_components(word_sets(df.collect()))


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(np.exp(rng.uniform(0, np.log(2000))))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        keep = rng.permutation(a)[: len(a) - rng.integers(0, len(a) // 5 + 1)]
        more = rng.integers(0, 1 << 63, rng.integers(0, len(a) // 4 + 1), dtype=np.int64).astype(np.uint64)
        b = np.unique(np.concatenate((keep, more)))
        both = len(np.intersect1d(a, b))
        if both and not np.array_equal(a, b) and 100 * both >= 80 * (len(a) + len(b) - both):
            (sa, na), (sb, nb) = jaccardjoin.sign(a), jaccardjoin.sign(b)
            shared = np.intersect1d(sa, sb)
            assert len(shared)
            # under some cut both share what each needs
            tags = shared & np.uint64(255)
            need = lambda s, x, t: x[(s & np.uint64(255)) == t].max()
            assert any((tags == t).sum() >= max(1, need(sa, na, t), need(sb, nb, t)) for t in np.unique(tags))


def test_repeated_ids_join_what_their_texts_link_to(spark):
    """One id with two unlike texts, each with near copies under other ids; a null id links nothing."""
    rng = random.Random(3)
    a, b, c = ([f"{x}{rng.randrange(10_000)}" for _ in range(60)] for x in "abc")
    near = lambda w, i: " ".join(w[:i] + ["changed"] + w[i + 1 :])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 30)), (5, near(a, 31)), (3, near(b, 30)), (4, near(b, 31)), (7, " ".join(c)), (8, near(c, 2)), (None, " ".join(c)), (9, ""), (1, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in jaccardjoin.link_components(df).collect())
    assert {(i, c) for i, c, _ in got} == {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 9)}
    assert len(got) == len(rows) and [n for i, _, n in got if i == 1] == [0, 56, 56]
    assert {r.doc_id for r in jaccardjoin.keep_first(df).collect()} == {None, 1, 7, 9}


def test_large_groups_of_loose_copies(spark, monkeypatch):
    """Copies of one text that link with some others only, in cells of few sets, and beyond all rounds."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(100_000)}" for _ in range(70)]
    texts = []
    for _ in range(90):
        words = list(base)
        for at in rng.sample(range(70), rng.choice((0, 1, 1, 2, 2, 3, 4))):
            words[at] = f"x{rng.randrange(100_000)}"
        texts.append(" ".join(words))
    df = documents(spark, texts)
    want = brute_components(word_sets(df.collect()))
    monkeypatch.setattr(jaccardjoin, "CELL", 700)
    monkeypatch.setattr(jaccardjoin, "GROUP", 7)
    for rounds in (0, 1):
        monkeypatch.setattr(jaccardjoin, "ROUNDS", rounds)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.link_components(df).collect()} == want


def test_jaccard_edge_cases(spark):
    df = odd(spark).unionByName(documents(spark, ["a b c d e f g"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("score", F.lit("")).withColumn("n_tokens", F.lit(0)))
    rows = jaccardjoin.link_components(df).collect()
    assert len(rows) == 13 and {r.component_id for r in rows if r.doc_id == 5} == {4} and [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = jaccardjoin.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id = 5").count() == 0
    assert jaccardjoin.link_components(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark, "t"), "t").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


# decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    items = [words(n) for n in (30, 30, 12, 3)]
    edited = list(items[0])
    edited[0] = "changed"
    cut = items[1][:15] + words(15)
    middle = items[1][:14] + ["changed"] + items[1][15:]
    texts = [
        " ".join(words(50) + items[0] + words(40)),
        "### ".join(items[1]).upper(),
        " ".join(words(9) + edited),
        " ".join(words(20) + cut),
        " ".join(items[2][:11]),
        "x, " + "! ".join(items[3]) + " y",
        " ".join(items[0]) + " mid " + " ".join(items[2]),
        None,
        "",
        " ".join(words(33) + middle + words(20)),
    ]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (8, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 0), (4, 2), (5, 3), (6, 0), (6, 2), (9, 1)}
    assert found[0, 0].first_word == 50 and found[0, 0].distance == 0 and found[2, 0].similarity < 1
    kept = decontaminate.keep_uncontaminated(documents(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert decontaminate.contaminated(odd(spark), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(spark, texts).limit(0), bench).count() == 0


def test_decontamination_against_brute_force(spark):
    """All windows of all texts: what holds 0.8 of an item's weight is found, within the recall of the radius."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [words(rng.choice((8, 20, 45))) for _ in range(25)]
    texts = []
    for k in range(260):
        copy = list(items[k % 25])
        for at in rng.sample(range(len(copy)), rng.randrange(0, 3)):
            copy[at] = words(1)[0]
        texts.append(" ".join(words(rng.randrange(0, 30)) + copy + words(rng.randrange(0, 30))))
    bench = [(None if k == 3 else k, " ".join(w)) for k, w in enumerate(items)] + [(None, " ".join(items[4])), (90, None), (91, "")]
    found = decontaminate.contaminated(documents(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}

    def shingles(w):
        return [(tuple(w[i : i + 5]), sum(map(len, w[i : i + 5]))) for i in range(len(w) - 4)]

    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for name, item in bench:
            i = (item or "").split()
            weight = shingles(i)
            need = Counter(s for s, _ in weight)
            if not weight or not need.keys() & {s for s, _ in shingles(w)}:
                continue
            worth = dict(weight)
            for at in range(max(1, len(w) - len(i) + 1)):
                have = Counter(s for s, _ in shingles(w[at : at + len(i)]))
                if sum(min(n, have[s]) * worth[s] for s, n in need.items()) >= 0.8 * sum(x for _, x in weight) - 1e-9:
                    want.add((d, name))
                    break
    assert got <= want and len(got) >= 0.98 * len(want) > 100
    assert {r.item_id for r in found} >= {None, 0, 4}


def test_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 2)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(7)], "item_id long, text string")
    docs = bench.select(F.col("item_id").alias("doc_id"), "text")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(7)}
    assert decontaminate.keep_uncontaminated(docs, bench).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    near = np.concatenate([items ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, (len(items), k), True).astype(np.uint64), axis=1) for k in (1, 9, 24, 28)])
    got = {(int(w), int(i)) for w, i, _ in zip(*decontaminate.HammingIndex(items).search(near))}
    want = {(w, i) for w in range(len(near)) for i in range(len(items)) if int(near[w] ^ items[i]).bit_count() <= decontaminate.RADIUS}
    assert got == want


# toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)

    def vector():
        v = {int(t): float(w) for t, w in zip(rng.choice(40, rng.integers(1, 6), False), rng.random(6))}
        n = sum(w * w for w in v.values()) ** 0.5
        return {t: w / n for t, w in v.items()}

    vectors = [vector() for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    fewer = 0
    for _ in range(60):
        q = vector()
        scores = sorted(((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors)))[:7]
        terms = np.array(sorted(q))
        found, opened = index.search(terms, np.array([q[t] for t in terms.tolist()]), 7)
        assert [(-s, i) for s, i in scores if s < 0] == found
        fewer += opened < index.n_blocks
    assert fewer > 30


def test_toxicity_of_held_out_rows(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score(labelled, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    clean, toxic = (rows[rows.toxic == k] for k in (0, 1))
    place = rows.score.rank()
    auc = (place[toxic.index].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc >= 0.95 and toxic.predicted.mean() >= 0.85 and clean.predicted.mean() <= 0.03


def test_toxicity_against_brute_force(spark):
    """The whole result on a small table: weights, cosines, votes and shrinkage, computed anew over dictionaries."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("awful", "nasty") if i % 4 == 0 and rng.random() < 0.4 else ("fine", "day", "sun", "rain", "tree", f"w{i % 7}")) for _ in range(rng.randint(1, 25))) for i in range(160)] + ["", None, "fine"]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 160) if i % 5], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    ids = {r.doc_id: r.text for r in df.collect()}
    bags = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in ids.items()}
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    n1 = sum(known.values())
    n0 = len(known) - n1
    a, b = Counter(w for i in known if known[i] for w in bags[i]), Counter(w for i in known if not known[i] for w in bags[i])
    frequency = Counter(w for i in bags for w in bags[i])
    worth = {}
    for w in set(a) | set(b):
        chi2 = (n0 + n1) * (a[w] * (n0 - b[w]) - b[w] * (n1 - a[w])) ** 2 / max(1e-9, (a[w] + b[w]) * (n0 + n1 - a[w] - b[w]) * n1 * n0)
        if chi2 >= toxicity.LEAST_CHI2:
            worth[w] = chi2 * (math.log((len(bags) + 1) / (frequency[w] + 1)) + 1)

    def vector(bag):
        v = {w: (1 + math.log(n)) * worth[w] for w, n in bag.items() if w in worth}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(bags[i]) for i in known}
    bare = [sum(1 for i in known if not vectors[i] and known[i] == c) for c in (0, 1)]
    base = bare[1] / max(1, sum(bare))
    for i in ids:
        v = vector(bags[i])
        near = sorted((-round(sum(x * vectors[j].get(w, 0) for w, x in v.items()), 9), j) for j in known if vectors[j])
        near = [(-s, j) for s, j in near if s < 0][: toxicity.NEIGHBOURS]
        want = (sum(s * known[j] for s, j in near) + base) / (sum(s for s, _ in near) + 1) if near else base
        assert abs(got[i].score - want) < 1e-6 and got[i].nearest_id == (near[0][1] if near else None), i


def test_toxicity_edge_cases(spark):
    texts = [f"you awful thing {i}" if i % 3 == 0 else f"good day number {i}" for i in range(90)]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(0, 1, 0), (500, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert rows[30].predicted == 1 and rows[31].predicted == 0 and texts[rows[30].nearest_id].startswith("you awful")
    strange = toxicity.score(odd(spark), model).collect()
    assert len(strange) == 12 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in strange)
    assert toxicity.keep_clean(df, model).columns == df.columns and toxicity.keep_clean(df, model).count() == 60
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.score(df, toxicity.fit(df, labels.limit(0))).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(df, toxicity.fit(df, labels.where("toxic = 1"))).agg(F.min("score")).first()[0] == 1
    assert toxicity.fit(df.limit(0), labels).base >= 0


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", common.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) == common.held_out_py(r.id) for r in rows)
    assert collections.Counter(r.h for r in rows)[True] > 3


def test_jaccard_tables_have_few_files_whatever_the_partitions(spark, monkeypatch):
    names = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, saved = {k: spark.conf.get(k) for k in names}, {}
    save = common.Scratch.save

    def counted(self, df, name):
        table = save(self, df, name)
        saved[name] = len(table.inputFiles())
        return table

    monkeypatch.setattr(common.Scratch, "save", counted)
    texts = [" ".join(f"w{(i // 4) * 50 + j}" for j in range(40)) + f" end{i % 4}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        most = common.files_of(spark)
        found = {r["doc_id"]: r["component_id"] for r in jaccardjoin.link_components(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i // 4 * 4 for i in range(400)}
    # the comparisons themselves stay spread over all tasks
    gathered = {k: n for k, n in saved.items() if k not in ("info", "sets", "first") and not k.startswith("links")}
    assert "owners" in gathered and "all-found" in gathered
    assert max(gathered.values()) <= most < 96
