"""The training-data operators against brute force, and on odd rows."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quillstone.llm import decontaminate, files, langid, line_dedup, near_copies, packing, quality_knn, quality_rules, rans, simhash, tokens, toxicity, warc
from quillstone.scratch import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, fp string, row int, hashes int, n_lines int, label string"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows():
    body = "The quick brown fox jumps over the lazy dog and runs away from all of them " * 5
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, body), (5, body), (6, body), (7, LONG), (None, body + "x"), (8, "Ünïcode ß Σας — 中文 \U0001f600 " * 20), (9, "x\ny\nx\nx")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, 1, "f", 2, 3, 4, "l") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (4, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- tokens -------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_tokenizer(), cache_words=50)
    rng = random.Random(2)
    signs = "aAbBéÉßİΣσ'sS1٣ \n\t  ́<|endoftext|>.,!#\U0001f600中\x85\xa0\u3000\u2028​\x1c\x00ǅ"
    cases = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["a<|endoftext|>b", LONG[:5000], "don't won't it's"]
    for text in cases:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert e.encode(None) == b""
    ids, counts = e.batch([None, *cases], most=5000)
    assert counts.tolist() == [0] + [len(e.tokenizer.encode(x, add_special_tokens=False).ids) for x in cases]
    assert ids.tolist() == [i for x in cases for i in e.tokenizer.encode(x, add_special_tokens=False).ids]
    assert [x.tolist() for x in e.batch([])] == [[], []]


# --- op1 ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n"), (5, "u", "other"), (None, "u", "<p>é</p>"), (6, "u", "z" * 3_000_000), (7, "u", "alone"), (7, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(df, f"{folder}/raw", records_per_file=4)
    archives = warc.normalise(spark, f"{folder}/raw", f"{folder}/out")
    got = warc.read_archives(archives, with_payload=True).collect()
    last = {}
    for k, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if k is None else k)
    want = []
    for k, _, h in pages:
        p = (h or "").encode()
        again = k != last[h or ""]
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert all(bytes(r["payload"]) in {(h or "").encode() for _, _, h in pages} for r in got if r["record_type"] == "response")


def test_warc_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.archive_pages(df, scratch_path(spark, "w"), least_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert warc.archive_pages(df.filter("page_id < 0"), scratch_path(spark, "w")).count() == 0


def test_damaged_archive_is_refused():
    whole = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, _, b in warc.records(iter([whole[:10], whole[10:], whole]))] == [b"abc", b"abc"]
    for bad in (whole[:-6], whole.replace(b": 3", b": 2"), b"WARC/1.1\r\nx"):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))


# --- op2, op4, op10 -----------------------------------------------------------------------------------------------


def check_scores(rows, n):
    assert len(rows) == n
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    for r in rows:
        assert r["held_out"] in (True, False)


def test_toxicity_odd(odd, none, labels):
    check_scores(toxicity.toxicity(odd, labels).collect(), odd.count())
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.filter("doc_id < 0")).collect()} == {0.0}


def test_quality_odd(odd, none, labels):
    check_scores(quality_knn.quality(odd, labels).collect(), odd.count())
    assert quality_knn.quality(none, labels).count() == 0
    assert {r["score"] for r in quality_knn.quality(odd, labels.filter("doc_id < 0")).collect()} == {0.5}


def test_long_texts_in_slices_count_the_same():
    counts = np.zeros((3, 1 << quality_knn.BITS), dtype=np.int64)
    texts = ["a b b", LONG, "c"]
    for rows, part in quality_knn.dense(texts):
        np.add.at(counts, rows, part)
    assert (counts.sum(axis=1) > 0).all() and counts[1].sum() >= 120_000


def planted(spark, n=600):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, marks = [], []
    for k in range(n):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        toxic, junk = k % 6 == 0, k % 5 == 1
        if toxic:
            body.insert(rng.randrange(len(body)), "vileword")
        text = " | ".join(f"{w}%%%" for w in body) if junk else " ".join(body)
        rows.append((k, text))
        marks.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out(spark):
    d, marks = planted(spark)
    t = toxicity.toxicity(d, marks).filter("held_out").join(marks, "doc_id").toPandas()
    assert (t["predicted"] == t["toxic"]).mean() > 0.97
    q = quality_knn.quality(d, marks).filter("held_out").join(marks, "doc_id").toPandas()
    assert (q["predicted"] == q["quality"]).mean() > 0.95


def test_nnpu_gradient_keeps_the_negative_risk_up():
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 20)) < 0.05).astype(np.float32)
    toxic = rng.random(2000) < 0.2
    x[toxic, 0] = 1
    x[~toxic, 0] = 0
    known = toxic & (rng.random(2000) < 0.5)
    w, b = toxicity.train_nnpu(x, known, 0.2)
    assert ((x @ w + b > 0) == toxic).mean() > 0.97


@needs_tables
def test_language(docs, odd, none):
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (both["lang"] == both["lang_pred"]).mean() > 0.9
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_scores_equal_plain_counts():
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b"], rng.integers(0, 50, (1 << langid.BITS, 2)).astype(float), np.array([3.0, 5.0]))
    texts = ["Hello  world", "", "x" * 700_000 + " y"]
    plain = []
    for t in texts:
        total = m.prior.copy()
        for at, part in langid.slices([t.lower()]):
            for bucket, _ in langid.gram_buckets(*langid.code_points(part)):
                total = total + m.log_p[bucket].astype(np.float64).sum(axis=0)
        plain.append(total.argmax())
    best, p = m.scores(texts)
    assert best.tolist() == plain and ((p > 0) & (p <= 1)).all()


def test_every_language_is_learnt(spark, monkeypatch):
    rng = random.Random(10)
    rows = []
    for k in range(70):  # the last are the rarest
        signs = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        rows += [(len(rows) + i, " ".join("".join(rng.choices(signs, k=4)) for _ in range(15)), f"l{k:02}") for i in range(20 if k < 60 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for block in (256, 32):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
        assert len(got) == len(rows) and set(got.values()) == {f"l{k:02}" for k in range(70)}
        assert sum(got[i] == lang for i, _, lang in rows) > 0.98 * len(rows)


# --- op3 ----------------------------------------------------------------------------------------------------------


def brute_components(ids, fps, most):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(fps, dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= most):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    group = {}
    for i in range(len(x)):
        group.setdefault(find(i), []).append(ids[i])
    least = {k: min([v for v in g if v is not None], default=None) for k, g in group.items()}
    return [least[find(i)] for i in range(len(x))]


def plain_fingerprint(text, n):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    own = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_in_parts(monkeypatch):
    texts = [None, "", " ", "One", "a b c", "a b c d", "a b c d e f A B", "É x Y z w q" * 30, LONG[:3000]]
    want = [plain_fingerprint(t, 4) for t in texts]
    for part in (1 << 22, 7, 40):
        monkeypatch.setattr(simhash, "_PART_BYTES", part)
        assert [simhash.fingerprint(t, 4)[0] & (1 << 64) - 1 for t in texts] == want
        assert [simhash.fingerprint(t, 4, 3)[0] for t in texts] == [simhash.fingerprint(t, 4)[0] for t in texts]


@pytest.mark.parametrize(("most", "bands"), [(4, 3), (8, 5), (4, 1)])
def test_trees_lose_no_pair(spark, most, bands):
    rng = random.Random(bands)
    base = [rng.getrandbits(64) for _ in range(900)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, most + 1))) for b in base[:400] for _ in range(2)]
    centre = rng.getrandbits(64)
    tight = [centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for _ in range(700)]
    fps = sorted({*base, *near, *tight})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from quillstone.operators.graph import stars

    links = simhash.fingerprint_links(df, most, bands, shard_rows=64)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 64 for r in links.limit(5).collect())
    got = {r["a"]: r["b"] for r in stars(links).collect()}
    want = dict(zip(signed, brute_components(signed, fps, most), strict=True))
    assert {f: got.get(f, f) for f in signed} == want


def test_shard_links_of_a_tight_cluster_and_scattered_points():
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    x = np.array(sorted({centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for _ in range(9000)} | {rng.getrandbits(64) for _ in range(500)}), dtype=np.uint64)
    links = np.concatenate(simhash.shard_links(x, (1 << 64) - 1, 4, 4, block=256))
    assert len(links) < 4 * len(x)


@needs_tables
def test_near_duplicates(docs, odd, none):
    mixed = docs.select("doc_id", "text").unionByName(docs.filter("doc_id < 5").select((F.col("doc_id") + 5000).alias("doc_id"), F.upper("text").alias("text")))
    rows = simhash.near_duplicates(mixed, shingle=4).collect()
    fps = [plain_fingerprint(t, 4) for t in [r["text"] for r in mixed.collect()]]
    by_id = {r["doc_id"]: r for r in rows}
    data = mixed.collect()
    want = brute_components([r["doc_id"] for r in data], fps, 4)
    for r, f, c in zip(data, fps, want, strict=True):
        assert by_id[r["doc_id"]]["fingerprint"] == f"{f:016x}" and by_id[r["doc_id"]]["component_id"] == c
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in out if r["doc_id"] in (5, 6)} == {5}
    assert simhash.near_duplicates(none).count() == 0
    kept = sorted([r["doc_id"] for r in near_copies.keep_one(odd).collect()], key=str)
    assert kept.count(5) == 1 and 6 not in kept and 2 not in kept and 1 in kept
    assert near_copies.keep_one(none).columns == none.columns and near_copies.keep_one(none).count() == 0


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_groups(texts):
    """Smallest position of each text's group, by the Jaccard similarity of all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    for base in range(12):
        own = [rng.choice(vocabulary) for _ in range(300)]
        for edits in [0, 0, 1, 2, 4, 5, 6, 7, 8, 10, 14, 20, 40][: 13 if base < 6 else 4]:  # 0.8 lies at about seven edits
            copy = list(own)
            for at in rng.sample(range(300), edits):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", " ", "a b", "A  b", "a c"]
    df = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, f0 string, key int")
    kept = {r["doc_id"] for r in near_copies.keep_one(df).collect()}
    want = {i for i, g in enumerate(brute_groups(texts)) if i == g}
    assert want <= kept and len(kept - want) <= 0.1 * (len(texts) - len(want))  # no clean text goes, nine in ten copies do


def test_sketches_pass_every_similar_pair_and_few_others():
    rng = np.random.default_rng(3)
    passed = {True: [], False: []}
    for n in (1, 5, 40, 300, 3000):
        for changed in (0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            b = np.unique(np.concatenate([a[round(changed * n) :], rng.integers(-(1 << 63), 1 << 63, round(changed * n))]))
            similar = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            passed[similar].append(bool(near_copies.may_be_similar(near_copies.sketch_of(b)[None], np.array([len(b)]), near_copies.sketch_of(a), len(a))[0]))
    assert all(passed[True]) and len(passed[True]) > 15 and np.mean(passed[False]) < 0.5
    none = near_copies.sketch_of(np.empty(0, dtype=np.int64))
    assert not none.any() and near_copies.may_be_similar(none[None], np.array([0]), none, 0).all()


def test_sketches_of_long_texts_that_share_a_template():
    """300 texts of 3,000 shingles with a common half: none is similar, and hardly any pair leaves the shard."""
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(-(1 << 63), 1 << 63, n))
    template = draw(1500)
    sets = [np.union1d(template, draw(1500 if k % 2 else 900)) for k in range(300)]
    sets += [np.union1d(sets[0][200:], draw(5)), np.union1d(draw(1060), template), draw(4090), draw(4100)]  # one near copy; others near a fold
    n, keys = np.array([len(x) for x in sets]), np.arange(len(sets))
    got = near_copies.remaining(keys, np.zeros(len(sets), dtype=np.uint64), keys, [near_copies.sketch_of(x) for x in sets], n)
    similar = {(i, j) for i in keys for j in keys[i + 1 :] if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    found = {tuple(sorted(pair)) for pair in got.tolist()}
    assert similar == {(0, 300)} and similar <= found and len(found) <= 3


def test_sketches_fold():
    a = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 5000)
    words = len(near_copies.sketch_of(a[:1000]))
    assert (near_copies.folded(near_copies.sketch_of(a), words) ^ near_copies.folded(near_copies.sketch_of(a[1000:]), words) == near_copies.sketch_of(a[:1000])).all()


@pytest.mark.parametrize("part", [256, 7])
def test_pairs_of_a_hot_text_are_dealt_to_parts(spark, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PAIRS_A_PART", part)
    rows = [(k, list(range(k % 7, 60 + k % 5)) if k % 3 else [k], None) for k in range(100)]
    sets = spark.createDataFrame(rows, near_copies.SETS)
    pairs = [(0, k) for k in range(1, 100)] + [(1, k) for k in range(2, 100)] + [(k, 99) for k in range(2, 99)]
    want = {(a, b) for a, b in pairs for x, y in [(set(rows[a][1]), set(rows[b][1]))] if len(x & y) >= 0.8 * len(x | y)}
    got = near_copies.verified(spark.createDataFrame(pairs, "a long, b long"), sets).collect()
    assert len(got) == len(want) > 50 and {(r["a"], r["b"]) for r in got} == want
    text = near_copies._with_shingles(*[spark.createDataFrame(pairs, "a long, b long")] * 2, sets, "a", "x").groupBy("a").agg(F.countDistinct("x").alias("n"), F.count("*").alias("pairs"))
    assert {(r["n"], r["pairs"] == sum(a == r["a"] for a, _ in pairs)) for r in text.collect()} == {(1, True)}


def test_near_copies_keep_a_defined_row(spark):
    a, b, c = ("one two three four five six seven " * 9, "ONE two three four five six seven " * 9, "other words of a text that is alone in its group")
    rows = [(7, a, "y"), (7, a, "x"), (7, b, "z"), (7, c, "w"), (9, a, "v"), (None, b, "u"), (None, c, "t"), (None, "null id alone here", "s")]
    for order in (rows, rows[::-1]):
        got = near_copies.keep_one(spark.createDataFrame(order, "doc_id long, text string, _key string").repartition(3)).collect()
        assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted([(7, min((a, b), key=lambda t: key_of(spark, t))), (7, c), (None, "null id alone here")], key=str)
        if got[0]["text"] == a or any(r["text"] == a for r in got):
            first = spark.createDataFrame(rows[:2], "doc_id long, text string, _key string").selectExpr("_key", "xxhash64(*) AS h").orderBy("h").first()["_key"]
            assert [r["_key"] for r in got if r["text"] == a] == [first]


def key_of(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(near_copies.text_key(F.col("text"))).first()[0]


# --- op5 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_containment(spark, odd, none, rows):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(40)] + [(100, "too short"), (104, "V7"), (105, "v3, v3"), (106, "..."), (107, "too short"), (101, None), (102, ""), (None, "a b c d e f g"), (103, "same w w w w w w w same")]
    docs = []
    for k in range(120):
        filler = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        item = items[k % 40][1].split()
        if k % 3 == 0:
            item = [w.upper() + "," for w in item]
        if k % 3 == 1:
            item[rng.randrange(len(item))] = "changed"
        if k % 3 == 2:
            item = item[: len(item) // 2]
        at = rng.randint(0, len(filler))
        docs.append((k, " ".join(filler[:at] + item + filler[at:])))
    docs += [(200, None), (201, ""), (None, items[0][1]), (0, docs[0][1]), (202, "this is Too short"), (None, "too, short"), (203, "too shortish"), (204, "v3 v3 v3"), (205, "v3 x v3 v7"), (206, "v33 v3")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("need", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in decontaminate.contained_items(d, i, broadcast_rows=rows).collect()}
    shingles = lambda t, k=5: {tuple(w[n : n + k]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for n in range(len(w) - k + 1)}
    want = {}
    for k, t in docs:
        for j, q in items:
            width = max(1, min(5, len(re.findall(r"[^\W_]+", q or ""))))
            s = shingles(q, width)
            if j is not None and s and len(s & shingles(t, width)) >= 0.8 * len(s):
                want[k, j] = (len(s), len(s & shingles(t, width)))
    assert got == want and len(want) > 40 and {(202, 100), (202, 107), (None, 100), (204, 105), (205, 104)} <= set(want) and (203, 100) not in want
    assert decontaminate.contained_items(none, i, broadcast_rows=rows).count() == 0
    assert decontaminate.contained_items(odd, i.filter("item_id < 0"), broadcast_rows=rows).count() == 0
    left = {r["doc_id"] for r in decontaminate.decontaminated(d, i).collect()}
    assert left == {k for k, _ in docs} - {k for k, _ in want}


# --- op6 ----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    c = Counter(windows)
    covered = {p for k, x in enumerate(windows) if c[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize(("low", "few"), [((1 << 20) - 1, 32), ((1 << 20) - 1, -1), (7, -1), (7, 1)])
def test_rule_counts(spark, odd, none, monkeypatch, low, few):
    monkeypatch.setattr(quality_rules, "_FEW", few)
    if low == 7:  # then texts of more than seven windows take the path of very long ones
        monkeypatch.setattr(quality_rules, "_LOW", low)
    extra = spark.createDataFrame([(50, "a b c a b c\n\na b c\n# x | y <z>\na b c"), (51, "x " * 200), (52, "one two three")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    rows = quality_rules.judged(odd.select("doc_id", "text", "lang").unionByName(extra), keep=["doc_id", "text", "lang"]).select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == odd.count() + 3
    for r in rows:
        want = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judged(none).count() == 0
    assert quality_rules.good_documents(odd).columns == odd.columns


def plain_distances(rows, limits):
    """Class, word and rest distance of each (text, lang), from plain counts over all rows."""
    import regex

    signs = {"c_lower": r"\p{Ll}", "c_upper": r"\p{Lu}", "c_caseless": r"[\p{Lo}\p{Lm}\p{Lt}]", "c_digit": r"\p{Nd}", "c_space": r"[\x20\x09-\x0D]", "c_punct": r"[.,;:!?'\"()\-]"}
    per_lang, chars, docs_of = {}, {}, Counter(lang for _, lang in rows)
    made = []
    for text, lang in rows:
        c = [len(regex.findall(signs[k], text or "")) for k in signs]
        made.append((Counter(w.lower() for w in words(text)), np.array([*c, len(text or "") - sum(c)], dtype=float)))
        per_lang.setdefault(lang, Counter()).update(made[-1][0])
        chars[lang] = chars.get(lang, 0) + made[-1][1]

    def distance(p, q):
        m = (p + q) / 2
        part = lambda v: sum(x * np.log2(x / y) for x, y in zip(v, m, strict=True) if x > 0)
        return np.sqrt(max(0.0, (part(p) + part(q)) / 2))

    out = []
    for (_, lang), (own, c) in zip(rows, made, strict=True):
        n = sum(own.values())
        if n < limits.test_words or lang is None or docs_of[lang] < limits.reference_docs:
            out.append((None, None, None))
            continue
        total = sum(per_lang[lang].values())
        common = sorted(w for w, k in per_lang[lang].items() if k > 1 and k / total >= limits.common_share)
        q, p = (np.array([x[w] for w in common], dtype=float) for x in (per_lang[lang], own))
        words_far = (distance(p / p.sum(), q / q.sum()) if p.sum() else 1.0) if common else None
        rest_far = distance(np.append(p, n - p.sum()) / n, np.append(q, total - q.sum()) / total) if common else None
        out.append((distance(c / c.sum(), chars[lang] / chars[lang].sum()), words_far, rest_far))
    return out


def check_distances(got, want):
    for r, w in zip(got, want, strict=True):
        for name, value in zip(("class_distance", "word_distance", "rest_distance"), w, strict=True):
            assert r[name] is None if value is None else r[name] == pytest.approx(value, abs=1e-9), (r, w)


@needs_tables
@pytest.mark.parametrize("broadcast", [quality_rules.BROADCAST_WORDS, 0])
def test_divergence_equals_numpy(docs, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_WORDS", broadcast)
    limits = quality_rules.Limits()
    rows = docs.orderBy("doc_id").collect()
    got = quality_rules.judged(docs).orderBy("row.doc_id").collect()
    check_distances(got, plain_distances([(r["text"], r["lang"]) for r in rows], limits))
    assert sum(r["word_distance"] is not None for r in got) > 50


def test_texts_with_hardly_any_common_word_fail_and_other_languages_stay(spark):
    rng = random.Random(6)
    common = [f"{a}{b}" for a in "tbwh" for b in ("he", "of", "is", "and", "or")]
    filler = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) + "q"
    made = lambda n, share: " ".join(rng.choice(common) if rng.random() < share else filler() for _ in range(n))
    clean = [(k, made(300, 0.5), "en") for k in range(60)]
    bad = [(100, made(400, 0.0), "en"), (101, " ".join([made(700, 0.0), *common[:4]]), "en"), (102, " ".join(filler() for _ in range(3000)) + " " + " ".join(common), "en")]
    signs = [chr(0x4E00 + 20 * k + i) for k in range(20) for i in range(15)]
    chinese = lambda: " ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(200))
    italian = " ".join(rng.choice("il lo la gli un una di del della che non per con sono come anche più questo era nel tutto ogni casa tempo".split()) + rng.choice(["", "", "o", "i", "re"]) for _ in range(200))
    other = [(200, italian, "it"), (201, italian + " e", None), (202, chinese(), "zh"), (203, made(79, 0.0), "en")] + [(300 + k, chinese(), "ja") for k in range(40)]
    rows = [*clean, *bad, *other]
    found = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("row.doc_id").collect()
    got = {r["row"]["doc_id"]: r for r in found}
    assert all(got[k]["kept"] for k in range(60)) and not any(got[k]["kept"] for k in (100, 101, 102))
    assert all(got[k]["kept"] for k, _, _ in other), [k for k, _, _ in other if not got[k]["kept"]]
    assert all(got[k]["class_distance"] is None for k in (200, 201, 202, 203)) and got[300]["class_distance"] < 0.05
    check_distances(found, plain_distances([(t, lang) for _, t, lang in rows], quality_rules.Limits()))


# --- op7, op9 -----------------------------------------------------------------------------------------------------


def test_tightest_bin():
    rng = random.Random(1)
    for capacity in (1, 5, 64, 100):
        bins, held = packing.OpenBins(capacity), []
        for k in range(400):
            if rng.random() < 0.6:
                r = rng.randint(0, capacity)
                bins.put(r, k)
                held.append(r)
            n = rng.randint(0, capacity)
            found = bins.tightest(n)
            best = min((x for x in held if x >= n), default=None)
            assert (found[1] if found else None) == best
            if best is not None:
                held.remove(best)


def test_packing(spark, odd, none):
    tokenizer = tokens.Encoder(tokens.default_tokenizer())
    got = packing.pack(odd, capacity=256, group_pieces=300, with_ids=True).collect()
    whole = Counter()
    for i, t, *_ in odd_rows():
        ids = tokenizer.encode(t) + bytes(4)
        for k, at in enumerate(range(0, len(ids), 1024)):
            whole[i, k, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == whole
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(none).count() == 0


@needs_tables
def test_lean_packing_gives_the_same(docs):
    rows = [sorted(map(tuple, packing.pack(docs, lean=lean).collect())) for lean in (False, True)]
    assert rows[0] == rows[1] and rows[0]


@needs_tables
def test_packing_is_tight(docs):
    got = packing.pack(docs).collect()
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len({r["sequence_id"] for r in got}) <= least + 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 300_000])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_999).astype(np.uint32)
    t = rans.Table.of_counts(np.bincount(ids, minlength=50_000))
    t = rans.Table.from_bytes(t.to_bytes())
    if n:
        lanes, marks, stream = rans.encode_ids(ids, t)
        assert (rans.decode_ids(n, lanes, marks, stream, t) == ids).all()
        for k in range(len(marks)):  # every checkpoint on its own
            part = rans.decode_ids(n, lanes, marks, stream, t, k, k + 1 if k + 1 < len(marks) else None)
            assert (part == ids[marks[k][0] * lanes :][: len(part)]).all() and len(part)
        raw = rans.block_bytes(rans.Block(7, [None, 3], np.array([0, n]), ids), t)
        import io

        block = rans.read_block(io.BytesIO(raw).read, t)
        assert (block.ids(t) == ids).all()
        for low, high in ((0, 0), (0, 1), (n // 3, n // 3 + 1), (n // 2, n), (n - 1, n)):
            assert (block.ids(t, low, high) == ids[low:high]).all()
        with pytest.raises(ValueError):
            rans.read_block(io.BytesIO(raw[:-1] + bytes([raw[-1] ^ 1])).read, t)


def test_rans_files(spark, odd, none):
    enc = tokens.Encoder(tokens.default_tokenizer())
    folder = scratch_path(spark, "rans-test")
    manifest = rans.write_tokens(odd, folder)
    got = sorted(rans.read_tokens(spark, manifest, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in odd_rows()], key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["ids"][-1] == 1
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(np.frombuffer(enc.encode(t), "<u4").tolist()) + (1,)) for i, t, *_ in odd_rows())
    whole = [i for r in got for i in r["ids"]]
    with files.stream(f"{folder}/table.qrt") as f:
        t = rans.Table.from_bytes(f.read())
    for m in manifest.collect():  # any range of a file through its index, from a middle checkpoint too
        for low, high in ((0, m["tokens"]), (m["tokens"] // 3, m["tokens"] // 2), (m["tokens"] - 1, m["tokens"])):
            low, high = m["start"] + low, m["start"] + high
            assert rans.read_range(m["path"], t, low, high).tolist() == whole[low:high]
    with pytest.raises(ValueError):
        rans.Table.of_counts(np.ones((1 << rans.SCALE) + 1, dtype=np.int64))
    empty = scratch_path(spark, "rans-test")
    assert rans.read_tokens(spark, rans.write_tokens(none, empty), empty).count() == 0


# --- op8 ----------------------------------------------------------------------------------------------------------


def test_lines(spark, odd, none):
    rows = [(k, f"top\n line {k}\n\nfoot  \ntop" if k % 2 else f"line {k}\n\tfoot", "h" if k < 40 else None) for k in range(60)] + [(k, "top", f"small{k}") for k in range(60, 64)] + [(99, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("drop", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert len(got) == len(rows)
    for k, t, h in rows:
        want = t
        if h == "h" and t:
            want = "\n".join(x for x in t.split("\n") if x.strip() not in ("top", "foot"))
        assert got[k]["text"] == want and got[k]["drop"] == 1
        assert got[k]["n_dropped"] == (0 if t is None else t.count("\n") + 1 - (want.count("\n") + 1))
    assert line_dedup.drop_boilerplate(odd).count() == odd.count()
    assert line_dedup.drop_boilerplate(none).count() == 0
    assert line_dedup.clean_documents(odd).columns == odd.columns


def test_copies_of_a_text_are_one_page_in_the_pipeline(spark):
    copied = "one text\nof several lines\nfoot"
    rows = [(k, f"own line {k}\nfoot", "h") for k in range(20)] + [(100 + k, copied, "h") for k in range(15)] + [(200 + k, copied, f"s{k // 5}") for k in range(10)]
    df = spark.createDataFrame([(i, t, h, len(t)) for i, t, h in rows], "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.clean_documents(df).collect()}
    want = {i: t.removesuffix("\nfoot") if h == "h" else t for i, t, h in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}


# --- SQL ----------------------------------------------------------------------------------------------------------


@needs_tables
@pytest.mark.parametrize(("query", "sql"), [(warc.op1_warc_normaliser, warc.OP1_SQL), (decontaminate.op5_minhash_containment, decontaminate.OP5_SQL), (line_dedup.op8_site_line_dedup, line_dedup.OP8_SQL)])
def test_against_sql(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(sql)
    df = query(spark, SF).select(*want.columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(df.collect()) == key(want.fetchall())


def test_short_items_against_sql(spark, tmp_path):
    """The SQL of operator 5 on items of one to four words, next to long ones."""
    texts = ["the gauge was read", "The GAUGE, was", "gauge", None, "", "one two three four five six seven", "five six", "gauges were read twice a day at noon", "was read; twice"]
    docs = [(k, t) for k, t in enumerate(texts)]
    items = [(1, "gauge was"), (2, "Gauge"), (3, "one two three four five six"), (4, "was read twice"), (5, ""), (6, "four five six seven"), (7, None)]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.sql(decontaminate.OP5_SQL)
    got = decontaminate.op5_minhash_containment(spark, str(tmp_path)).select(*want.columns).collect()
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(got) == key(want.fetchall()) and len(got) > 6
