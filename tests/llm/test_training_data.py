"""Each operator against a brute-force version, a library or a round trip, on small and awkward tables."""

import hashlib
import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from conftest import DATA, assert_same

from tidemark.llm import components, elias_fano, fixity, language, language_model, licenses, mixing, pieces, queries, runtime, sentencepieces, simhash, token_counts, topk, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \t\n", "one", "Two words", "a b c", "A B C", "licensed under the mit license", "1 2 3 4", "😀 é ▁x ﬁ", "x" * 5000, "\x00\x7f", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash by case."""
    rows = [(i if i != 4 else None, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 1, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6]], f"{DOCS}, size long, TEXT string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


def test_sentencepiece_equals_library(docs, odd):
    library = pieces.load(queries.vocabulary()).library
    for frame in (docs.limit(60), odd):
        text = {(r.doc_id, r.text) for r in frame.collect()}
        want = sorted((str(i), " ".join(map(str, [*library.encode(t or ""), 2])), library.decode([*library.encode(t or ""), 2])) for i, t in text)
        got = sorted({(str(r.doc_id), r.ids, r.decoded) for r in sentencepieces.encode(frame, queries.vocabulary()).collect()})
        assert got == want
    one = sentencepieces.decode(sentencepieces.encode(docs.limit(5), queries.vocabulary()), queries.vocabulary())
    assert {r.doc_id: r.text for r in one.collect()} == {r.doc_id: r.text for r in docs.limit(5).collect()}


def test_agenda_forms_agree():
    p, rng = pieces.load(queries.vocabulary()), random.Random(3)
    for _ in range(500):
        w = "".join(rng.choice("▁aehtinr\né") for _ in range(rng.randint(1, 80)))
        assert p.merge_long(w) == p.merge(w[:48]) if len(w) <= 48 else p.merge_long(w) == p.merge(w)


def test_token_counts_at_every_prefix(docs, odd):
    library = pieces.load(queries.vocabulary()).library
    for r in token_counts.prefix_counts(odd, queries.vocabulary()).collect():
        assert r.counts[0] == 0
    texts = [t for t in ODD if t and len(t) < 200] + [r.text[:150] for r in docs.limit(5).collect()]
    p = pieces.load(queries.vocabulary())
    for t in texts:
        assert token_counts.text_counts(p, t) == [len(library.encode(t[:k])) for k in range(len(t) + 1)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count(docs, queries.vocabulary()).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), len(library.encode(r.text))) for r in docs.collect()}
    for r in token_counts.truncate(docs.limit(20), queries.vocabulary(), 25).collect():
        assert r.n_tokens == len(library.encode(r.text)) <= 25


def brute_groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_bits_and_groups(docs, odd):
    import xxhash

    rng = random.Random(8)
    # The last text has more shingles than are hashed at once.
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**7 + i, t) for i, t in enumerate(ODD)] + [(5 * 10**7, " ".join(f"w{rng.randint(0, 900)}" for _ in range(70000)))]
    same = sorted(((r.doc_id, r.component_id) for r in simhash.components(odd).collect()), key=str)
    assert len(same) == len(ODD) + 1 and {c for i, c in same if i in (0, 1, 2)} == {0} and (None, None) in same and same.count((6, 5)) == 2
    docs = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "text AS Text2")
    fps = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) if h else np.zeros(64, int)
        fps[i] = sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(h))
    ids = sorted(fps)
    want = brute_groups(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    for limit in (256, 2):
        got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.components(docs, cell_limit=limit).collect()}
        assert got == {i: (fps[i], want[i]) for i in ids}


def test_simhash_links_planted_distances(spark):
    """Distances 0 to 4 around many centres, in small and in crowded cells."""
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        for d in (0, 1, 2, 3, 4, 3, 2):
            x = c
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = brute_groups(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    for limit in (256, 1):
        found = brute_groups(fps, [(r.u % 2**64, r.v % 2**64) for r in simhash.links(frame, limit).collect()])
        assert found == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    near = [base[i % 6] + rng.normal(size=8) * 0.05 for i in range(60)]
    rows = [(i, v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate([*base, *near])]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [None] * 8, 1), (204, [], 1), (205, [1.0, 2.0], 1), (300, rows[1][1], 1), (301, [2 * x for x in rows[1][1]], 1), (301, [2 * x for x in rows[1][1]], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fair = [(k, i, np.array(v), lab) for k, (i, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for a in fair for b in fair if a[0] != b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / math.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= 0.98]
    root, n = brute_groups(range(len(rows)), links), Counter(a for a, _ in links)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    want = sorted(((r[0], n[k], least.get(root[k])) for k, r in enumerate(rows)), key=str)
    for kw in ({}, {"share": 2.0, "chunk_rows": 4, "salt_rows": 9}):
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(frame, **kw).collect()), key=str) == want
    some = [(i, np.floor(1024 * np.array(v, float))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    pad = [(i, np.concatenate([x, np.zeros(8 - len(x))])) for i, x in some]
    top = sorted((i, r, j, int(s)) for i in {i for i, _ in pad if i % 100 == 0} for x in [next(x for k, x in pad if k == i)] for r, (s, j) in enumerate(sorted(((x @ y, j) for j, y in pad if j != i), key=lambda t: (-t[0], t[1]))[:10], 1))
    for kw in ({}, {"pivots": 3, "rings": 5, "block_rows": 7, "first_rows": 11}):
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, **kw).collect()) == top
    pivots = vector_dedup._pivots(frame.where("vec_id < 120").selectExpr("label", "size(embedding) dim", "vec_id tie", "embedding", "shiftrightunsigned(xxhash64(vec_id), 2) _hash"), 0.25)
    assert pivots.count() > pivots.select("label").distinct().count()
    none = frame.where("false")
    assert topk.top_k(none).count() == 0 and vector_dedup.near_duplicates(none).count() == 0


def test_topk_closes_annuli_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=16) for _ in range(40)]
    rows = [rows[i % 40] / np.linalg.norm(rows[i % 40]) + rng.normal(size=16) * 0.03 for i in range(2000)]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rows)]
    rows += [(5000 + i, [0.25] * 16) for i in range(50)]  # equal vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS Block", "0 AS x", "1 AS `x.y`")
    kw = {"first_rows": 60, "block_rows": 40}
    seen = topk.opened(frame, **kw).collect()
    assert len(seen) == 21 and all(r.all_rows == 2050 for r in seen)
    assert sum(r.open_rows for r in seen) < 0.3 * sum(r.all_rows for r in seen) and sum(r.open_annuli for r in seen) < 0.5 * sum(r.annuli for r in seen)
    X = {i: np.floor(1024 * np.array(v)) for i, v in rows}
    top = sorted((i, rank, j, int(s)) for i in X if i % 100 == 0 for rank, (s, j) in enumerate(sorted(((X[i] @ x, j) for j, x in X.items() if j != i), key=lambda t: (-t[0], t[1]))[:10], 1))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, **kw).collect()) == top


def test_vectors_that_share_an_id(spark):
    """One vec_id over different vectors and labels: as many rows come out as went in, each with its own links."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(5, a, 1), (5, b, 1), (5, a, 2), (7, c, 1), (9, b, 1), (9, b, 1), (None, c, 1), (None, [0.0, 0.0, 1.0], 1), (None, [0.0, 0.01, 1.0], 1), (8, a, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id AS tie", "label AS dim", "0 AS Vec_ID2", "vec_id AS `vec.id`")
    want = sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 0, 5, True), (7, 2, 5, False), (9, 2, 5, False), (9, 2, 5, False), (None, 2, 5, False), (None, 1, None, False), (None, 1, None, False), (8, 0, 8, True)], key=str)
    for kw in ({}, {"share": 5.0, "chunk_rows": 1, "salt_rows": 1}):
        assert sorted((tuple(r) for r in vector_dedup.near_duplicates(frame, **kw).collect()), key=str) == want


def test_language(docs, odd, empty):
    net, langs = language.fit(docs, steps=80)
    assert langs == sorted(langs) and set(langs) <= {"de", "en", "es", "fr"}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.identify(docs, net, langs).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in held)
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, net, langs).collect()}
    assert got[0] == got[1] == got[2] == got[8] == got[11] == "und" and got[3] in langs
    assert language.fit(empty) == (None, []) and language.identify(docs, None, []).where("lang_pred <> 'und'").count() == 0
    assert language.keep(odd, net, langs, least=0.0).columns == odd.columns
    assert len(language.label_positions(net, langs, "Thé ende")) == len("Thé ende".encode())


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language.Network(3, hidden=3, seed=1)
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    x, y, mask = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5), (rng.random((6, 5)) > 0.2).astype(float)
    _, g = net.gradients(x, y, mask)
    for k in ("out", "bias", "rec_f", "rec_b", "in_f", "in_b"):
        i = (int(x[2, 1]), 4) if k.startswith("in") else tuple(0 for _ in net.w[k].shape)
        net.w[k][i] += 1e-4
        up = net.gradients(x, y, mask)[0]
        net.w[k][i] -= 2e-4
        down = net.gradients(x, y, mask)[0]
        net.w[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][i]) < 2e-3


def test_language_model(docs, odd, empty):
    for frame in (docs, odd):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b" "]) for r in frame.collect()]
        # n-grams by tuple; None stands for the start of a text, once before its first token.
        c, n_docs = Counter(), 0
        for i, w in rows:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                for n in (1, 2, 3, 4):
                    c.update(zip(*([None, *w][k:] for k in range(n))))
                n_docs += 1
        N, V = sum(v for k, v in c.items() if len(k) == 1 and k[0]), sum(len(k) == 1 and k[0] is not None for k in c)
        base = lambda w: (c[w,] + 1) / (N + V + 1)

        def p(h, w):
            return (c[*h, w] + 50 * p(h[1:], w)) / (c[h] + 50) if h else base(w)

        want = sorted((str(i), len(w), sum(c[x,] > 0 for x in w), N, round(sum(math.log10(base(x)) for x in w), 6)) for i, w in rows)
        for order, kw in ((3, {}), (3, {"shard_tokens": 500}), (2, {"order": 2}), (4, {"order": 4, "shard_tokens": 3000})):
            got = language_model.score(frame, language_model.train(frame, **kw)).collect()
            assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
            own = sorted((str(i), sum(math.log10(p(tuple([None, *w][max(0, k + 2 - order) : k + 1]), x)) for k, x in enumerate(w)), len(w)) for i, w in rows)
            for (i, s, n), (j, t) in zip(own, sorted((str(r.doc_id), r.score) for r in got), strict=True):
                assert i == j and abs(s - t) < 2e-4 * n
    assert language_model.score(empty, language_model.train(empty)).count() == 0
    assert {r.base_score for r in language_model.score(odd, language_model.train(empty)).collect()} == {0.0}


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(2)
    for values in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.arange(2000, dtype=np.uint64), np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64)), np.unique(np.concatenate([np.arange(300), 2**40 + np.arange(300)])).astype(np.uint64)):
        elias_fano.save(str(tmp_path / f"f{len(values)}"), elias_fano.build(values, "x"))
        s = elias_fano.Sequence(elias_fano.mapped(str(tmp_path / f"f{len(values)}")), "x")
        assert (s.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2**63, 100, dtype=np.uint64)])
        where = {int(v): i for i, v in enumerate(values)}
        assert s.find(asked).tolist() == [where.get(int(v), -1) for v in asked]


def test_mixing(docs, odd, empty, spark):
    for frame in (docs, odd):
        rows = mixing.mix(frame).collect()
        assert len(rows) == frame.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame.repartition(3)).collect()))
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, aim = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[source[r.doc_id]] += r.taken
        aim[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.02 * t + 64 for s, t in aim.items())
    assert mixing.mix(empty).count() == 0
    # Rows without an id and repeated rows are laid in pieces, over several shards, and each has its share.
    same = spark.createDataFrame([(None, "w " * (1 + i % 3), "a") for i in range(300)] + [(7, "w w w w", "b")] * 90, "doc_id long, text string, source string")
    for piece in (256, 8):
        rows = mixing.mix(same, piece_rows=piece, shard_docs=2)
        assert rows.count() == 390 and all(0 <= r.taken <= 3 * r.size for r in rows.collect())
        for r in rows.groupBy("target").agg({"taken": "sum"}).collect():
            assert abs(r.target - r["sum(taken)"]) <= 32
        assert sorted(map(str, rows.collect())) == sorted(map(str, mixing.mix(same.repartition(5), piece_rows=piece, shard_docs=2).collect()))
    # One source far too small for its weight: its target stops at three times its size.
    few = spark.createDataFrame([(i, "w " * 400, "a") for i in range(9)] + [(10, "w " * 30, "b")], "doc_id long, text string, source string")
    assert {r.source_size: r.target for r in mixing.mix(few).collect()} == {30: 90.0, 3600: 3540.0}
    quota = mixing.apportion(spark.createDataFrame([(i, float(v), 25) for i, v in enumerate((98, 61, 41, 7, 0))], "i int, v double, s long"), "v", "s", [], ["i"])
    best = Counter(i for _, i in sorted(((-v / (2 * k + 1), i) for i, v in enumerate((98, 61, 41, 7)) for k in range(25)))[:25])
    assert {r.i: r.quota for r in quota.collect()} == {i: best[i] for i in range(5)}


def test_licenses(odd, docs):
    got = {r.doc_id: [h.template for h in r.hits] for r in licenses.scan(odd).collect()}
    assert got[0] == got[1] == [] and got[7] == ["MIT"]  # four words of five
    plain = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    hits = {r.doc_id: {h.template for h in r.hits if h.coverage == 1} for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        assert {k for k, v in plain.items() if v in r.text} <= hits[r.doc_id]
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    twice = "x " * 500 + "Released under the MIT License. Released under the MIT License. " + "y " * 500
    assert s.scan(twice)[0][:3] == ("MIT", 1.0, 500)
    assert s.scan("Released hereby under the MIT big License")[0][:2] == ("MIT", 1.0) and not s.scan("the MIT of license")
    a, b = "p q r s t".split(), "q p r t s".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len(pairs) == 3


def test_licenses_at_every_offset():
    s = licenses.Scanner({"GPL-3.0": licenses.TEMPLATES["GPL-3.0"], "MIT": "Released under the MIT License."}, 0.8)
    for notice, name, length in (
        ("This work is licensed under the one two three four five six GNU General Public License version 3", "GPL-3.0", 18),
        ("This a b c work a b c is a b c licensed a b c under a b c the a b c GNU a b c General a b c Public a b c License a b c version a b c 3", "GPL-3.0", 45),
        ("Released a b c d under a b c d the a b c d MIT a b c d License", "MIT", 21),
    ):
        for k in range(60):
            got = [h for h in s.scan("filler " * k + notice + " filler" * 9) if h[0] == name]
            assert got == [(name, 1.0, k, k + length - 1)]
    assert s.scan("license the Released under the MIT License. Released under the MIT License. the")[0] == ("MIT", 1.0, 2, 6)


def test_licenses_are_told_apart(docs):
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    plain = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    found = {r.doc_id: [h.template for h in r.hits] for r in licenses.scan(docs).collect()}
    assert all(found[r.doc_id] == sorted(k for k, v in plain.items() if v in r.text) for r in docs.collect()) and any(found.values())
    for text, want in {
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Licensed under CC BY NC 4.0.": ["CC-BY-NC-4.0"],
        "Licensed under CC BY-NC-ND 3.0.": ["CC-BY-NC-ND-3.0"],
        "Licensed under CC BY-XX 4.0.": [],
        "Licensed under CC BY-SA 3.0 and CC BY 4.0.": ["CC-BY-4.0", "CC-BY-SA-3.0"],
        "Licensed under CC BY 4.0. " + "x " * 50 + "Licensed under CC BY-NC 4.0.": ["CC-BY-4.0", "CC-BY-NC-4.0"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
        "See https://creativecommons.org/licenses/by-sa/4.0/": ["CC-BY-SA-4.0"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2, clause 3.": ["GPL-2.0"],
        "Dual licensed under the MIT License or the Apache License, Version 2.0": ["Apache-2.0", "MIT"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "Licensed under the Apache License, Version 1.1.": [],
        "The licensed press is under the old bridge by the river.": [],
    }.items():
        assert [h[0] for h in s.scan(text)] == want, text
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert [h[:2] for h in s.scan("Some words before. " + t.replace("{", "").replace("}", "") + " Some after.")] == [(name, 1.0)], t
            cut = licenses.words(t)
            if len(cut) > 100:
                assert [h[0] for h in s.scan(" ".join(w for k, w in enumerate(cut) if k % 12 or w in ("endorse", "promote", "appear", "copies", "apache", "2.0")))] == [name]


def brute_fixity(rows, new, file_records):
    """Both sides laid out plainly; (page_id, status) of every record."""
    files = max(1, -(-len(rows) // file_records))
    key = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:15], 16)
    text = lambda r: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1] or ''}" + ("" if r[2] is None else f"\r\nContent-Length: {len(r[2].encode())}") + f"\r\n\r\n{r[2] or ''}\r\n\r\n"
    sha = lambda r: hashlib.sha256(text(r).encode()).hexdigest()
    kinds = [{}, {}]
    for side, rs in enumerate((rows, new)):
        for r in rs:
            kinds[side].setdefault(r[0], set()).add(sha(r))
    many = {None} | {i for k in kinds for i, v in k.items() if len(v) > file_records}
    sides = []
    for rs in (rows, new):
        by_file = {}
        for r in rs:
            by_file.setdefault(-1 - key(sha(r)) % files if r[0] in many else key(r[0]) % files, []).append((r[0] is not None, r[0] or 0, sha(r), len(text(r).encode())))
        found = {}
        for f, held in by_file.items():
            offset = 0
            for at, (has, i, s, n) in enumerate(sorted(held)):
                who = (f, has, i, s if f < 0 else "")
                found.setdefault(who, []).append((at, offset, n, s))
                offset += n
        sides.append(found)
    places = [{(w[0], at): (o, n, s) for w, v in side.items() for at, o, n, s in v} for side in sides]
    bad = {p for p in places[0].keys() | places[1].keys() if places[0].get(p) != places[1].get(p)}
    out = []
    for w in sides[0].keys() | sides[1].keys():
        a, b = ([x for x in side.get(w, []) if (w[0], x[0]) in bad] for side in sides)
        i = w[2] if w[1] else None
        out += [(i, "same")] * sum((w[0], x[0]) not in bad for x in sides[0].get(w, []))
        out += [(i, "changed" if x[3] != y[3] else "moved") for x, y in zip(a, b)] + [(i, "lost")] * max(0, len(a) - len(b)) + [(i, "gained")] * max(0, len(b) - len(a))
    return sorted(out, key=str)


def test_fixity(spark):
    kind = "page_id long, url string, html string, File int, at string"
    frame = lambda rs: spark.createDataFrame([(*r, 1, None) for r in rs], kind)
    rows = [(i * 7919, f"http://h/{i}", None if i == 5 else "<p>" + "x" * i) for i in range(300)] + [(7919, "u", "")] * 3 + [(None, None, None)] * 2
    own = fixity.records(frame(rows), 64)
    assert fixity.audit(own, own, 4).count() == 0 and own.select("file").distinct().count() > 3
    broken = [(i, u, "" if h is None else h) if i != 9 * 7919 else (i, u + "?", h) for i, u, h in rows]
    assert sorted(((r.page_id, r.status) for r in fixity.located(frame(rows), frame(broken), 64, 4).collect()), key=str) == brute_fixity(rows, broken, 64)
    first = own.agg({"file": "max"}).first()[0]
    lost = fixity.audit(own, own.where(f"file <> {first}"), 4).collect()
    assert sorted((r.file, r["at"]) for r in lost) == [(first, i) for i in range(own.where(f"file = {first}").count())]
    none = frame([])
    assert fixity.located(none, none).count() == 0 and {r.status for r in fixity.located(none, frame(rows), 64).collect()} == {"gained"}
    assert {r.status for r in fixity.located(frame(rows), none, 64).collect()} == {"lost"}
    r = own.where(f"page_id = {3 * 7919}").first()
    text = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/3\r\nContent-Length: 6\r\n\r\n<p>xxx\r\n\r\n"
    assert r.length == len(text) and r.leaf == hashlib.sha256(f"{r.offset}:{r.length}:{hashlib.sha256(text.encode()).hexdigest()}".encode()).hexdigest()


def test_fixity_of_lost_gained_moved_and_crowded_records(spark):
    kind = "page_id long, url string, html string"
    rows = [(i, f"http://h/{i}", "x" * i) for i in range(200)] + [(None, "u", f"n{i}") for i in range(9)] + [(7, "v", "")] + [(5000, "hot", str(i)) for i in range(90)] + [(6000, "same", "s")] * 80
    new = [r for r in rows if r[0] not in (20, 130) and r != (None, "u", "n3") and r != (5000, "hot", "8")]
    new += [(20, "http://h/20", "longer" * 9), (160, "again", ""), (1000, "w", "more"), (None, "u", "n-new"), (5000, "hot", "new"), (6000, "same", "s")]
    pages, replica = spark.createDataFrame(rows, kind), spark.createDataFrame(new, kind)
    for fan in (4, 16):
        found = fixity.located(pages, replica, 64, fan).collect()
        assert all(r.damaged == (r.status != "same") for r in found)
        assert sorted(((r.page_id, r.status) for r in found), key=str) == brute_fixity(rows, new, 64)
    kinds = {(r.page_id, r.status) for r in found}
    assert {(130, "lost"), (20, "changed"), (1000, "gained"), (None, "lost"), (None, "gained"), (5000, "lost"), (5000, "gained"), (6000, "gained")} <= kinds and any(s == "moved" for _, s in kinds)


def test_forgotten_words_change_no_result():
    small, large = pieces.Pieces(queries.vocabulary(), keep_bytes=2048), pieces.Pieces(queries.vocabulary())
    texts = [f"alpha beta w{i % 7} x{i} {'long' * (i % 5)}" for i in range(60)] + ["", " ", "alpha"]
    for t in texts:
        assert small.encode_batch([t]) == large.encode_batch([t]) == [" ".join(map(str, large.library.encode(t, add_eos=True)))]
        words = large.split(large.spaced(t))
        assert [list(c) for c in small.count_words(words)] == [list(c) for c in large.count_words(words)]
    assert len(small.encoded.young) + len(small.encoded.old) < 40


def test_empty_tables(empty):
    v = queries.vocabulary()
    found = [licenses.scan(empty), sentencepieces.encode(empty, v), token_counts.count(empty, v), token_counts.prefix_counts(empty, v), token_counts.truncate(empty, v, 5), simhash.components(empty), simhash.keep_one(empty), language.identify(empty, None, []), mixing.mixed_documents(empty)]
    assert [d.count() for d in found] == [0] * len(found)
    decoded = sentencepieces.decode(empty.selectExpr("doc_id", "text AS ids"), v)
    assert decoded.columns == ["doc_id", "text"] and decoded.count() == 0


def test_texts_longer_than_a_slice(spark):
    """Longer than the slices that operators cut batches into: 2, 4 and 8 MB."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé中 ") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = {1: " ".join(rng.choice(words) for _ in range(1_300_000)), 2: "short", 3: "x" * 300_000, 4: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    library = pieces.load(queries.vocabulary()).library
    ids = {i: [*library.encode(t or ""), 2] for i, t in texts.items()}
    assert len(texts[1].encode()) > 8 << 20
    got = {r.doc_id: (r.n_tokens, hash(r.ids), r.decoded) for r in sentencepieces.encode(frame, queries.vocabulary()).collect()}
    assert got == {i: (len(x), hash(" ".join(map(str, x))), texts[i] or "") for i, x in ids.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count(frame, queries.vocabulary()).collect()} == {i: len(x) - 1 for i, x in ids.items()}
    net = language.Network(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame, net, ["a", "b", "c"]).collect()}
    plain = language.pooled(net, [texts[1].encode()], 3)[0]
    assert got[1][0] == "abc"[plain.argmax()] and abs(got[1][1] - plain.max()) < 1e-6 and got[4] == ("und", 0.0)
    c = Counter(w for t in texts.values() for w in (t or "").encode().lower().split() + [b" "])
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in language_model.score(frame, language_model.train(frame, fold=99, folds=100)).collect()}
    assert got == {i: (n := len((t or "").encode().split()) + 1, n, sum(c.values())) for i, t in texts.items()}


def test_memory_of_long_words_is_bounded():
    """Scripts without spaces and encoded blobs make words of any length; they are charged with their bytes."""
    p, rng = pieces.Pieces(queries.vocabulary(), keep_bytes=4 << 20), random.Random(3)
    import pyarrow as pa

    for _ in range(30):
        texts = pa.array([" ".join("".join(rng.choice("abcdefgh中文") for _ in range(200)) for _ in range(100)) for _ in range(10)])
        p.encode_texts(texts, check=False)
        p.count_texts(texts)
    for g in (p.encoded, p.counted):
        size = sum(sys.getsizeof(w) + sys.getsizeof(x) for held in (g.young, g.old) for w, x in held.items())
        assert size < 12 << 20 and len(g.young) + len(g.old) < 30_000


def test_prediction_equals_a_plain_forward_pass():
    """Every byte's distribution by loops over bytes, hidden units and classes, and the mean over a text's bytes."""
    rng = np.random.default_rng(5)
    net = language.Network(3, hidden=4, seed=2)
    texts = ["Thé quick brown fox, and a long tail of words that fills more than one window of bytes.".encode(), b"x", b"", bytes(rng.integers(1, 255, 130).tolist())]
    w, H = {k: v.astype(float) for k, v in net.w.items()}, 4

    def direction(x, d):
        h, out = np.zeros(H), [None] * len(x)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a, b = w[f"in_{d}"][x[t]], h @ w[f"rec_{d}"]
            z, r = (np.clip(0.2 * (a[k] + b[k]) + 0.5, 0, 1) for k in (slice(0, H), slice(H, 2 * H)))
            c = a[2 * H :] + r * b[2 * H :]
            c = c / (1 + abs(c))
            h = (1 - z) * h + z * c
            out[t] = h
        return out

    want = []
    for t in texts:
        total = np.zeros(3)
        for k in range(0, len(t), language.WINDOW):
            part = list(t[k : k + language.WINDOW])
            x = part + [0] * (language.WINDOW - len(part))
            f, b = direction(x, "f"), direction(x, "b")
            for i in range(len(part)):
                y = np.concatenate([f[i], b[i]]) @ w["out"] + w["bias"]
                e = np.exp(y - y.max())
                total += e / e.sum()
        want.append(total / max(1, len(t)))
    assert np.abs(language.pooled(net, texts, 3) - np.array(want)).max() < 1e-5


def test_licenses_equal_a_quadratic_alignment():
    """Coverage of the best stretch against the longest common subsequence over every stretch, of texts with words changed, dropped and put in."""
    rng = random.Random(11)
    notice = "permission is granted to use copy and share this {acme} work under these terms"
    s, plain = licenses.Scanner({"acme": notice}, 0.8), licenses.words(notice)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    seen = [0, 0]
    for _ in range(150):
        text = list(plain)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(text))
            kind = rng.random()
            if kind < 0.4:
                text[k] = rng.choice(["other", "word", "the"])
            elif kind < 0.7:
                del text[k]
            else:
                text[k:k] = [rng.choice(["very", "plain"])] * rng.randint(1, 4)
        text = ["filler"] * rng.randint(0, 20) + text + ["filler"] * rng.randint(0, 20)
        # Here any common subsequence that has the telling word is in one chain: all other words are strange to the notice.
        best = lcs(text, plain) if "acme" in text else 0
        want = round(best / len(plain), 9) if best >= 0.8 * len(plain) else None
        got = s.scan(" ".join(text))
        assert (round(got[0][1], 9) if got else None) == want, text
        seen[want is not None] += 1
    assert min(seen) > 20


def test_two_encoders_of_many_words_agree():
    p, rng = pieces.load(queries.vocabulary()), random.Random(6)
    words = sorted({"".join(rng.choice(" aehtinrs é中😀ß.,0") for _ in range(rng.randint(1, 60))).replace("\n", "") for _ in range(2000)})
    words = [w for w in words if w.strip(" ") == "" or " " not in w.lstrip(" ")]
    assert p.found(words) == [p.to_ids(p.merge(w.replace(" ", pieces.MARK))) for w in words]


def test_words_are_hashed_together_and_grams_searched_with_few_reads(monkeypatch):
    import pyarrow as pa

    words = [b"a", b"b", b"A\0", b"\0", b"\0\0", b"eightbyt", b"eightbyte", b"x" * 64, b"x" * 63 + b"y", "é".encode() * 9]
    texts = pa.array([b" ".join(words).decode(), None, "", "  b\t A ", b" ".join(words[5:]).decode()])
    # Only words of more than 64 bytes may be hashed on their own.
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "xxhash", None)
        t = language_model.Tokens(texts)
    assert t.sizes.tolist() == [11, 1, 1, 3, 6] and len(set(t.hashes.tolist())) == len(words) + 1
    assert t.codes.tolist() == [*range(10), 10, 10, 10, 1, 0, 10, 5, 6, 7, 8, 9, 10]
    long = language_model.Tokens(pa.array(["z" * 65 + " " + "z" * 66, "z" * 66, "b"]))
    assert long.codes.tolist() == [0, 1, 3, 1, 3, 2, 3] and long.hashes[2] == t.hashes[1] and long.hashes[3] == t.hashes[10]

    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 1 << 40, 5000), np.concatenate([np.arange(3000), rng.integers(0, 1 << 50, 2000)]), np.arange(200) << 55, rng.integers(0, 1 << 62, 3), np.array([0]), np.array([], np.int64)):
        values = np.unique(values).astype(np.uint64)
        s = elias_fano.Sequence(elias_fano.build(values, "v"), "v")
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 63, 99).astype(np.uint64), np.array([0, (1 << 63) + 5, (1 << 64) - 1], np.uint64)])
        place = {v: i for i, v in enumerate(values.tolist())}
        assert s.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]
    # A bucket of one value is read once, and one of n values once more than it is halved.
    reads, s = [], elias_fano.Sequence(elias_fano.build(np.arange(1000, dtype=np.uint64) * 1024, "v"), "v")
    lows = s._lows
    s._lows = lambda i: reads.append(len(i)) or lows(i)
    assert s.find(np.arange(1000) * 1024).tolist() == list(range(1000))
    assert sum(reads) <= 2000

    for x in (rng.integers(0, 50, 999), rng.integers(0, 1 << 62, 99), np.array([5]), np.array([], np.int64), np.array([-1, 3, -1])):
        for got, want in zip(language_model.unique(x), np.unique(x, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_memory_of_a_scored_slice_is_bounded(docs, monkeypatch):
    """Of these texts a slice takes 60 bytes a token, and gives them back before the next; it took 160, and workers kept them, when an executor passed 3,000 MB."""
    import pyarrow as pa

    model, texts = language_model.train(docs), [r.text for r in docs.collect()] * 6

    class Rows:
        withColumn = lambda self, *_: self
        mapInArrow = lambda self, f, schema: f

    monkeypatch.setattr(language_model, "pick", lambda *_, **__: Rows())
    run, released = language_model.score(docs, model), []
    monkeypatch.setattr(language_model, "release", lambda: released.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([False] * len(texts))], ["doc_id", "text", "held_out"])
    tokens = sum(sum(x.column("n_tokens").to_pylist()) for x in run([batch]))
    tracemalloc.start()
    slices = len(list(run([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens > 200_000 and peak < 100 * tokens
    assert len(released) == slices // 2 * 3


def test_released_memory_leaves_the_process():
    def held():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) / 1024

    pieces_ = [np.ones(12_000) for _ in range(1000)]
    most, pins = held(), pieces_[99::100]
    del pieces_
    runtime.release()
    assert len(pins) == 10 and held() < most - 60
