"""Periodic runs, the parity-sketch join and spelling variants against brute force, and on odd rows."""

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
from quillstone.llm import parity_join, runs, spelling

from .test_operators import SF, docs, needs_tables, none, odd, odd_rows, words  # noqa: F401  fixtures

# --- op11 ---------------------------------------------------------------------------------------------------------


def brute_runs(w, least):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            own = w[start : i + q]
            if len(own) >= max(least, 2 * q) and not any(own[:-d] == own[d:] for d in range(1, q)):
                found.append((start, len(own), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(2500):
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.5 and w:
            a, p = rng.randrange(len(w)), 1 + rng.randrange(12)
            w = w[:a] + (w[a : a + p] * len(w))[: len(w) - a]
        least = rng.choice([4, 6, 7, 12])
        n, found, collapsed = runs.text_runs(b"\n ".join(w), least)
        assert n == len(w) and found == brute_runs(w, least)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        assert collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_long_texts_are_linear():
    for w in ([b"%d" % (i % 700) for i in range(60_000)], [b"a"] * 60_000):
        assert [(s, n) for s, n, _ in runs.runs_of(w)] == [(0, 60_000)]


def planted_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@needs_tables
def test_op11(spark, docs):  # noqa: F811
    got = {r["doc_id"]: r for r in runs.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        w = planted_words(row["doc_id"], words(row["text"]))
        if len(w) > 3000:
            continue
        found, r = brute_runs(w, 12), got[row["doc_id"]]
        best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_runs_of_odd_rows(spark, odd, none):  # noqa: F811
    got = runs.periodic_runs(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows())
    body = next(r for r in got if r["doc_id"] == 6)
    assert [tuple(x) for x in body["runs"]] == [(0, 80, 16)] and body["collapsed"].split() == words(odd_rows()[4][1])[:16]
    assert all(r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert runs.periodic_runs(none).collect() == []


# --- op12 ---------------------------------------------------------------------------------------------------------


def brute_links(texts, width=4, percent=85):
    sets = []
    for t in texts:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    shared = Counter((a, b) for v in index.values() if len(v) < 400 for i, a in enumerate(v) for b in v[i + 1 :])
    return sets, [(a, b) for (a, b), k in shared.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]


def brute_components(ids, texts):
    sets, links = brute_links(texts)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, i in enumerate(ids)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"e{rng.randrange(10**6)}"], [w[k], f"i{rng.randrange(10**6)}"]])
    return w


def test_linked_sets_have_a_key_in_common():
    rng = np.random.default_rng(4)
    tight = 0
    for _ in range(6000):
        n = int(rng.integers(1, rng.choice([8, 40, 300, 2000])))
        own = rng.integers(0, 1 << 63, size=n, dtype=np.uint64)
        gone, new = (int(x) for x in rng.integers(0, n // 8 + 2, size=2))
        other = np.concatenate([own[gone:], rng.integers(0, 1 << 63, size=new, dtype=np.uint64)])
        shared, union = n - min(gone, n), n + new
        if 100 * shared >= 85 * union and (gone or new):
            tight += 100 * shared < 88 * union
            a, b = np.sort(own), np.sort(other)
            assert set(parity_join.join_keys(a).tolist()) & set(parity_join.join_keys(b).tolist())
            x, y = parity_join.sketch(a), parity_join.sketch(b)
            least = min(len(x), len(y))
            assert np.bitwise_count(parity_join.folded(x, least) ^ parity_join.folded(y, least)).sum() <= gone + new
    assert tight > 100


def test_join_against_all_pairs(spark):
    rng = random.Random(6)
    rows, ids = [], iter(range(1, 10**6))
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 8, 12, 40, 150, 600]))]
        for _ in range(rng.choice([3, 25])):
            rows.append((next(ids), " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 18)))))
    shared = [f"p{k}" for k in range(50)]  # texts with one long passage in common, below the similarity
    rows += [(next(ids), " ".join(shared + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 20))])) for _ in range(60)]
    rows += [(next(ids), t) for t in ("", None, " \n", "a b", "A  B", "a b c", "one two three four", "ONE two\nthree four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components([r[0] for r in rows], [r[1] for r in rows])
    assert sorted(tuple(r) for r in parity_join.jaccard_components(df).collect()) == want


def test_large_groups_in_blocks(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(1, 9)))) for k in range(150)]
    sets = [parity_join.shingle_set(t.encode()) for _, t in rows]
    keys = [parity_join.set_key(s) for s in sets]
    members = spark.createDataFrame([(7, k) for k in sorted(set(keys))], "word long, key long")
    table = spark.createDataFrame([(k, s.view(np.int64).tolist(), bytearray(parity_join.sketch(s).tobytes())) for k, s in dict(zip(keys, sets, strict=True)).items()], "key long, shingles array<long>, sketch binary")
    none = spark.createDataFrame([], "a long, b long")  # noqa: F811
    groups = parity_join.mixed_groups(members, none)
    small = parity_join.verified(parity_join.small_pairs(groups), table, 85)
    large = parity_join.verified(parity_join.large_pairs(groups, table, 85, block=40).select("a", "b").distinct(), table, 85)
    closest = parity_join.large_pairs(groups, table, 85, 1, block=40).filter("a IS NOT NULL").count()
    assert parity_join.large_pairs(groups, table, 85, 1, block=40).filter("more = 7").count()
    assert not parity_join.large_pairs(groups, table, 85, 150).filter("more IS NOT NULL").count()
    want = {tuple(sorted((keys[a], keys[b]))) for a, b in brute_links([t for _, t in rows])[1] if keys[a] != keys[b]}
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()} == want and len(want) > 100
    assert 0 < closest <= 4 * len(rows)


def test_join_of_odd_rows(spark, odd, none, monkeypatch):  # noqa: F811
    for most in (10**6, 0):
        monkeypatch.setattr(parity_join, "BROADCAST_KEYS", most)
        got = parity_join.jaccard_components(odd).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows())
        by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
        assert [by[(k, 0)] for k in (1, 2, 3)] == [1, 2, 3] and by[(5, 16)] == by[(6, 16)] == by[(None, 17)] == 5
    assert parity_join.jaccard_components(none).collect() == []


@needs_tables
def test_op12_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({parity_join.OP12_SQL})").fetchall())
    got = parity_join.op12_parity_join(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


# --- op13 ---------------------------------------------------------------------------------------------------------


def brute_variants(rows, slip, least_count=3):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slip and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= least_count}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for own in holes.values():
        for a in own:
            near[a] |= own - {a}
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_reduced_neighbourhood_is_whole():
    rng = random.Random(3)
    for _ in range(2000):
        w = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(1, 9)))
        k, c = rng.randrange(len(w)), rng.choice("abzÿ")
        v = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
        assert spelling.reduced(v) in spelling.neighbourhood(spelling.reduced(w))
        assert spelling.reduced(w) in spelling.neighbourhood(spelling.reduced(v))


@needs_tables
def test_op13(spark, docs):  # noqa: F811
    got = spelling.op13_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()], True)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 1000


def test_variants_of_odd_rows(spark, odd, none):  # noqa: F811
    text = "colour " * 20 + "color " * 9 + "colr " * 4 + "Ünïcödé ünïcödé Ünicödé " * 3 + "ÀÀÀÀÀ " * 3 + "abcd abcd abcd abcd×efgh÷ " * 3
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(None, text), (77, "tie" * 3 + " " + "aaaab " * 6 + "aaaac " * 6 + "aaaad " * 3)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["word"]: r for r in spelling.variants(df).collect()}
    want = brute_variants(rows, False)
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.values()} == want
    assert got["aaaad"]["form"] == "aaaab" and got["color"]["root"] == "colour" and got["colr" if "colr" in got else "color"]["form"] == "colour"
    assert spelling.variants(none).collect() == []


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)] + [("x", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {f"w{k}": "w13" for k in range(13)} | {"x": "w13"}
    assert spelling.roots(forms.filter(F.lit(False))).collect() == []
