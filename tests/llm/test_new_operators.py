"""Source audit, centroids and suffix dedup against brute force, on small tables with nulls, copies, ties and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkbars.llm import queries, source_audit, suffix_dedup, wht_kmeans

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# source audit


def brute_audit(rows, least=3, ranks=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(TERM.findall(lower(text)))
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, t, v, k + 1) for k, (t, v) in enumerate(items[:most])}
    return out


@pytest.mark.parametrize("shard, slice_, ranks", [(1 << 24, 1 << 16, 200), (64, 3, 2)])
def test_audit(spark, shard, slice_, ranks):
    rng = random.Random(3)
    words = ["Ab", "ab", "été", "ÉTÉ", "ÿ", "中文", "z", "antidisestablishmentarianism", "antidisestablishmentarian", "abcdefgh", "abcdefghi", "x1y", "it's"]
    rows = [(None, None, None), ("", "en", "lonely"), (" ".join(rng.choice(words) for _ in range(3000)), "en", "a"), ("z" * 5000, "en", None), ("!!", "fr", "b")]
    rows += [(rng.choice([" ", "-", "\x00"]).join(rng.choice(words[: rng.randint(1, 13)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", None])) for _ in range(80)]
    rows += [rows[9], rows[9]]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "text string, lang string, source string, term string, n int, item string").repartition(3)
    got = [tuple(r) for r in source_audit.audit_sources(frame, ranks=ranks, shard=shard, slice_=slice_).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, ranks=ranks)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit_sources(none).count() == 0
    frame = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y")], "text string, lang string, source string")
    got = sorted(tuple(r) for r in source_audit.audit_sources(frame).collect())
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]  # no term in three documents


def test_audit_has_no_limit_of_counts(spark):
    """Counts whose product with the unit passes 64 bits."""
    import pandas as pd

    n = [10**11, 3 * 10**10]
    sources = pd.DataFrame({"lang": "en", "source": ["a", "b"], "total": [n[0], 2 * n[1]], "kept": 2})
    got = source_audit._pair_sums(pd.DataFrame({"lang": "en", "source": ["a", "b", "b"], "term": ["t", "t", "u"], "n": [n[0], n[1], n[1]]}), sources)
    p = [[1 + 10**9 * (x + 1) // (total + 2) for x in row] for row, total in (((n[0], 0), n[0]), ((n[1], n[1]), 2 * n[1]))]
    want = {("a", "b"): sum((x - y) ** 2 // y for x, y in zip(*p)), ("b", "a"): sum((y - x) ** 2 // x for x, y in zip(*p))}
    assert {(r.source, r.item): r.value for r in got.itertuples()} == want
    share = spark.createDataFrame([(10**17, 2 * 10**17, 10**9)], "n long, total long, kept long").select(source_audit._share("n", "total", "kept")).first()[0]
    assert share == 1 + 10**9 * (10**17 + 1) // (2 * 10**17 + 10**9)


@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x or 1 for x in b)), max_size=60), st.integers(1, 64))
@settings(max_examples=60, deadline=None)
def test_multikey_sort(words, small):
    words = words + words[:7] + [b"ab" * 100, b"ab" * 100 + b"c"]
    text = np.frombuffer(b"".join(words) + b"\0" * 8, np.uint8)
    length = np.array([len(w) for w in words])
    order, runs = source_audit.multikey_sort(text, np.cumsum(np.r_[0, length[:-1]]), length, small)
    got = [words[k] for k in order]
    assert got == sorted(words) and [got[k] for k in runs] == sorted(set(words))


# centroids


def brute_clusters(rows, k=8, rounds=10, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and all(abs(1024 * x) <= wht_kmeans.MOST for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    draw = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [v for _, v in draw[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for n in range(len(centroids)):
            if own := [v for (_, v), b in zip(kept, best) if b[1] == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    best = assign()
    of = Counter()
    for d, n in best:
        of[n] += d
    fits = lambda x: x if x < 1 << 63 else None
    return Counter((i, n, d, fits(of[n]), fits(sum(of.values())), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, best))


def test_clusters(spark):
    rng = random.Random(5)
    point = lambda far=1.0: [float(np.float32(rng.gauss(0, far))) for _ in range(64)]
    rows = [(k, point()) for k in range(60)] + [(100 + k, point(1e4)) for k in range(12)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, point()), (200, None), (201, []), (202, [1.0] * 63), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64), (207, [0.0] * 64), (208, [1e30] * 64), (209, [1.0] * 65)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, c string").repartition(3)
    got = Counter(tuple(r) for r in wht_kmeans.cluster(frame).collect())
    assert got == brute_clusters(rows)
    few = frame.filter("vec_id IN (0, 1, 2, 206, 207)")
    assert Counter(tuple(r) for r in wht_kmeans.cluster(few).collect()) == brute_clusters([r for r in rows if r[0] in (0, 1, 2, 206, 207)])
    empty = wht_kmeans.cluster(frame.limit(0))
    assert empty.count() == 0 and empty.schema == wht_kmeans.cluster(few).schema


@given(st.integers(1, 12), st.integers(1, 30), st.integers(0, 29), st.integers(0, 2**32))
@settings(max_examples=80, deadline=None)
def test_progressive_search(k, n, bits, seed):
    rng = np.random.default_rng(seed)
    most = 1 << min(bits, 27)
    x, c = (rng.integers(-most, most + 1, (m, 64)) for m in (n, k))
    c[-1] = c[0]  # a tie
    number, distance, added = wht_kmeans.nearest_centroid(wht_kmeans.coefficients(x), wht_kmeans.coefficients(c))
    full = ((x[:, None].astype(object) - c.astype(object)) ** 2).sum(2)
    assert number.tolist() == full.argmin(1).tolist() and distance.tolist() == full.min(1).tolist()
    assert (wht_kmeans.components(wht_kmeans.coefficients(x)) == x).all()


def test_progressive_search_gives_up_worse_centroids():
    rng = np.random.default_rng(1)
    c = rng.integers(-3000, 3000, (8, 64)) + np.arange(8)[:, None] * 2000
    x = c[rng.integers(0, 8, 500)] + rng.integers(-50, 50, (500, 64))
    assert wht_kmeans.nearest_centroid(wht_kmeans.coefficients(x), wht_kmeans.coefficients(c))[2] < 0.3 * 500 * 8 * 64


# suffix dedup


@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_suffix_array(s, times):
    t = s * times + [0]
    sa = suffix_dedup.suffix_array(np.array(t))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    common = suffix_dedup.permuted_prefixes(np.array(t, np.uint16), sa)
    for a, b in zip(sa, sa[1:]):
        n = 0
        while t[a + n] == t[b + n]:
            n += 1
        assert common[b] == n


def brute_repeats(texts, length):
    """Of each text the removed spans and what stays."""
    raw = [(t or "").encode() for t in texts]
    often = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if often[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def planted_texts(rng, length):
    word = lambda: "".join(rng.choice("abcdeé中 ") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(3 * length) for _ in range(3)]
    texts = [None, "", "x", prose(5), "ab" * 4 * length, "ab" * 2 * length + "c", "z" * (length - 1), "z" * length, "q" * (length + 1), shared[0], shared[0], shared[0][: length + 3], "\0" * length, "\0\1" * length]
    texts += [prose(rng.randint(0, 3 * length)) for _ in range(20)]
    texts += [prose(rng.randint(0, 20)) + (s := rng.choice(shared))[: rng.randint(length // 2, len(s))] + prose(rng.randint(0, 20)) for _ in range(40)]
    return texts + [t[:k] + "Ü" + t[k:] for t in texts[14:20] for k in (len(t) // 2, len(t) // 3)]


@pytest.mark.parametrize("length, cell, ways, shard", [(12, 4096, 8, 1 << 20), (12, 2, 2, 200), (30, 3, 4, 500), (1, 4096, 8, 1 << 20), (2, 3, 2, 100)])
def test_remove_repeats(spark, length, cell, ways, shard):
    texts = planted_texts(random.Random(length), max(length, 10))
    frame = spark.createDataFrame([(k, t, "x", 1, b"k", 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, id string, start int, kept binary, h int, cell int").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, length, cell=cell, ways=ways, shard=shard).collect()}
    assert len(got) == len(texts)
    for k, (size, spans, kept) in enumerate(brute_repeats(texts, length)):
        assert (got[k].n_bytes, [tuple(s) for s in got[k].spans], bytes(got[k].kept)) == (size, spans, kept), (k, texts[k])


def test_remove_repeats_across_pieces(spark, monkeypatch):
    """Windows of one text that tasks look at in several pieces; repeated and missing ids."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 37)
    texts = [t.encode() for t in planted_texts(random.Random(9), 12) if t]
    text = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    seen = set()
    for doc, _, anchor, first, last in suffix_dedup.window_runs(text, offsets, 12, 4):
        for d, a, x, y in zip(doc, anchor, first, last):
            assert offsets[d] <= x <= a and y <= a <= x + 8 + (y - x) and y + 12 <= offsets[d + 1]
            windows = set(range(x, y + 1))
            assert not seen & windows
            seen |= windows
    assert seen == {i for a, b in zip(offsets, offsets[1:]) for i in range(a, b - 11)}
    frame = spark.createDataFrame([(None, "abcabcabd"), (1, "xxabcabx"), (1, "xxabcabx"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame, 5).collect())
    assert got == [(0, 0, b""), (0, 9, brute_repeats(["abcabcabd", "xxabcabx", "xxabcabx"], 5)[0][2]), (1, 8, b""), (1, 8, b"")]
    assert suffix_dedup.remove_repeats(frame.limit(0), 5).count() == 0


def test_a_hot_passage_is_split(spark):
    """One passage in a third of many documents, each time between other words."""
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = prose(150)
    texts = [prose(rng.randint(60, 90)) + passage * (k % 3 == 0) + prose(rng.randint(60, 90)) for k in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(frame, 100, cell=20, ways=3, shard=4000).collect()}
    assert got == {k: kept for k, (_, _, kept) in enumerate(brute_repeats(texts, 100))}


def test_equal_documents_have_equal_runs_wherever_pieces_end(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(4)
    copy = bytes(rng.choices(b"abcd", k=40))
    texts = [x for k in range(12) for x in (copy, bytes(rng.choices(b"abcd", k=k)), b"")]
    offsets = np.cumsum([0, *map(len, texts)])
    runs = {}
    for piece in suffix_dedup.window_runs(np.frombuffer(b"".join(texts), np.uint8), offsets, 12, 4):
        for doc, h, *places in zip(*piece):
            runs.setdefault(int(doc), []).append((int(h), *(int(x - offsets[doc]) for x in places)))
    assert len(runs[0]) > 1 and all(runs[k] == runs[0] for k in range(0, len(texts), 3))


def traced_mb(f):
    """Result and peak MB of what Python and numpy take meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_tasks_memory_does_not_follow_its_text():
    """Runs of texts and windows of a shard are found a part at a time."""
    rng = np.random.default_rng(1)
    offsets = np.arange(0, (6 << 20) + 1, 2048)
    text = rng.integers(97, 123, offsets[-1], np.uint8)
    n, mb = traced_mb(lambda: sum(len(x[0]) for x in suffix_dedup.window_runs(text, offsets, 400, 133)))
    assert n > 30_000 and mb < 80, mb

    def shard(cells):
        rows = [(c, 10 * c + k, 0, 0, 133, text[2000 * c : 2000 * c + 533 - 100 * (k == 2)].tobytes()) for c in range(cells) for k in range(3)]
        return pd.DataFrame(rows, columns=["cell", "id", "at", "x0", "x1", "bytes"]).sample(frac=1, random_state=3)

    small, mb_small = traced_mb(lambda: suffix_dedup.repeated_in_cells(shard(30), 400, 8000))
    large, mb_large = traced_mb(lambda: suffix_dedup.repeated_in_cells(shard(300), 400, 8000))
    assert len(small) == 90 and len(large) == 900 and set(small.itertuples(index=False)) <= set(large.itertuples(index=False))
    assert mb_large < 3 * mb_small, (mb_small, mb_large)
    whole = suffix_dedup.repeated_in_cells(shard(300), 400, 1 << 30)
    assert sorted(map(tuple, whole.to_numpy().tolist())) == sorted(map(tuple, large.to_numpy().tolist()))


@pytest.mark.parametrize("sizes, most, want", [([], 5, []), ([(1, 9)], 5, [(0, 1)]), ([(1, 2), (1, 2), (2, 1), (3, 4), (3, 9), (4, 1), (5, 1)], 5, [(0, 3), (3, 5), (5, 7)])])
def test_cells_together(sizes, most, want):
    cell, size = (np.array([x[k] for x in sizes], np.int64) for k in (0, 1))
    assert list(suffix_dedup.cells_together(cell, size, most)) == want


# queries


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_centroids", "op13_suffix_dedup"])
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, small), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(rel.select(*columns).fetchall(), key=str)


# secret scans


def test_identifiers_and_paths_with_digits_are_no_secrets(spark):
    """Of 200 each at most 2 are reported, and of 200 random runs of 24 and more at least 190."""
    from sparkbars.llm import secret_scan

    rng = random.Random(4)
    words = "user cache index node report cluster token session account invoice handler buffer request response worker queue batch config metric shard replica region zone bucket upload parser schema table column driver task stage event stream window offset commit snapshot".split()
    some = lambda n: [rng.choice(words) for _ in range(n)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = {
        "identifier": lambda: "_".join(some(3)) + f"_v{rng.randint(1, 9999)}",
        "path": lambda: "/".join(some(4)) + f"/{rng.randint(2010, 2025)}-{rng.randint(1, 12):02d}",
        "camel": lambda: "".join(w.capitalize() for w in some(3)) + str(rng.randint(1, 999)),
        "constant": lambda: "_".join(some(3)).upper() + f"_{rng.randint(1, 64)}",
        "dated": lambda: f"{rng.randint(2010, 2025)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}_{rng.choice(words)}-{rng.randint(0, 10**6)}",
        **{f"random {n}": lambda n=n: "".join(rng.choice(alphabet) for _ in range(n)) for n in (24, 32, 40)},
    }
    rows = [(k, f"see {make()} there", name) for k, (name, make) in enumerate((name, make) for name, make in planted.items() for _ in range(200))]
    ratio = secret_scan.train_markov(secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    found = Counter()
    kinds = {k: name for k, _, name in rows}
    for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, name string"), ratio).collect():
        found[kinds[r.doc_id]] += r.n_random
    for name in planted:
        assert found[name] >= 190 if name.startswith("random") else found[name] <= 2, found


def test_empty_tables_of_simhash_and_mixing(spark):
    from sparkbars.llm import mixing, simhash

    none = spark.createDataFrame([], "doc_id long, text string, source string, fingerprint string, taken int")
    assert simhash.near_duplicates(none).count() == 0 and mixing.mix(none).count() == 0
    assert {"doc_id", "fingerprint", "component_id"} <= set(simhash.near_duplicates(none).columns)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(mixing.mix(none).columns)
