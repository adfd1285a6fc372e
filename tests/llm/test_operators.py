"""Each operator against brute force, its SQL, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import chunks, covertree, dartminhash, kernels, mixing, packing, pii, quality, queries, secrets, suffixes, toxicity


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet' order by doc_id").fetchall())


@pytest.fixture(scope="module")
def results(spark, sf):
    made = {}

    def get(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, sf).collect()
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(results, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = [tuple(r.asDict()[k] for k in want.columns) for r in results(name)]
    assert sorted(got) == sorted(want.fetchall())


def test_mix_is_near_its_targets(results):
    by = Counter()
    for r in results("op1_mix_sources"):
        assert r.taken <= 3 * r["size"]
        by[r.target] += r.taken
    sizes = max(r["size"] for r in results("op1_mix_sources"))
    sources = Counter(r.target for r in results("op1_mix_sources"))
    assert all(abs(v - k) <= 3 * sizes for k, v in by.items() if sources[k] and k > 10 * sizes)


def test_quality_held_out(results, sf):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    held = [(r.predicted, labels[r.doc_id]) for r in results("op2_quality") if r.held_out and labels.get(r.doc_id) is not None]
    assert len(held) > 10 and sum(a == b for a, b in held) / len(held) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in results("op2_quality"))


def removed_by_brute_force(docs):
    first = {}
    for i, t in docs:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], 1 << 62), i)
    out = {}
    for i, t in docs:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                mask[p : p + 50] = True
        out[i] = mask
    return out


def test_repeated_strings(results, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    want = removed_by_brute_force(sorted(raw.items()))
    for r in results("op3_repeated_strings"):
        mask = want[r.doc_id]
        kept = np.frombuffer(raw[r.doc_id], np.uint8)[~mask].tobytes()
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(mask), mask.sum(), spans, hashlib.sha256(kept).hexdigest())
    assert any(m.any() for m in want.values())


def test_merge_knows_prefixes():
    rng = np.random.default_rng(1)
    words, shared = [], []
    for _ in range(150):
        w = rng.integers(0, 3, (rng.integers(0, 60), suffixes.WORDS)).astype(np.uint64)
        w = w[np.lexsort(w.T[::-1])]
        words.append(w)
        shared.append(np.concatenate([[0], (w[1:] == w[:-1]).cumprod(axis=1).sum(axis=1)])[: len(w)])
    words, shared = [w for w in words if len(w)], [s for w, s in zip(words, shared, strict=True) if len(w)]
    order, common = suffixes.merge_all(words, shared)
    every = np.concatenate(words)
    assert sorted(order) == list(range(len(every)))
    got = every[order]
    assert (got == every[np.lexsort(every.T[::-1])]).all()
    assert (common[1:] == (got[1:] == got[:-1]).cumprod(axis=1).sum(axis=1)).all()


def test_runs_and_parts_decide_alike():
    rng = np.random.default_rng(2)
    bits = [bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)) for _ in range(25)]
    docs = [(i, b"".join(bits[k] for k in rng.integers(0, 25, rng.integers(0, 9)))) for i in range(90)] + [(90, b"ab" * 400), (91, b"ab" * 300), (92, b"")]
    docs += [(93, bytes(200) + b"x" * 70), (94, b"y" + bytes(60)), (95, b"x" * 61 + bytes(70) + b"end"), (96, bytes(49) + b"q" * 20 + bytes(51))]
    want = removed_by_brute_force(docs)
    got = {i: np.zeros(len(t), bool) for i, t in docs}
    parts, met, runs_of = {p: [] for p in range(3)}, {p: [] for p in range(3)}, []
    for a in range(0, len(docs), 20):
        some = docs[a : a + 20]
        runs_of.append((np.frombuffer(b"".join(t for _, t in some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for _, t in some])]), np.array([i for i, _ in some])))
        keys = suffixes.Keys(3)
        keys.add(*runs_of[-1])
        for p, packed in keys.flush():
            met[p].append(suffixes.Keys.unpack(packed))
    bitmap = np.stack([suffixes.marked(met[p], suffixes.mark_bits(3, 1 << 20)) for p in range(3)])
    assert 0 < np.unpackbits(bitmap).sum() < sum(len(set(np.concatenate(v))) for v in met.values())
    for raw, offsets, ids in runs_of:
        writer = suffixes.Writer(3, bitmap)
        writer.add(raw, offsets, ids, np.arange(len(ids)))
        runs, gone = writer.flush()
        for p, packed in runs:
            parts[p].append(packed)
        for i, _, x, y in gone:
            got[i][x:y] = True
    for packed in parts.values():
        for i, _, x, y in suffixes.repeated([suffixes.Run(x) for x in packed]):
            got[i][x:y] = True
    assert all((got[i] == want[i]).all() for i, _ in docs)


@pytest.mark.parametrize("bits", [None, 2])
def test_context_hashes_decide_nothing(monkeypatch, bits):
    """Copies in a run are removed if their bytes agree, whatever their hashes; without a bitmap all suffixes travel."""
    if bits is not None:
        plain = suffixes.span_hashes
        monkeypatch.setattr(suffixes, "span_hashes", lambda *a: plain(*a) % np.uint64(1 << bits))
    rng = np.random.default_rng(13)
    bits_of = [bytes(rng.integers(97, 101, 60).astype(np.uint8)) for _ in range(6)]
    docs = [(i, b"".join(bits_of[k] for k in rng.integers(0, 6, 3)) + b"-%d" % i) for i in range(40)]
    want, got = removed_by_brute_force(docs), {i: np.zeros(len(t), bool) for i, t in docs}
    runs_of = []
    for some in (docs[:25], docs[25:]):
        w = suffixes.Writer(1)
        w.add(np.frombuffer(b"".join(t for _, t in some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for _, t in some])]), np.array([i for i, _ in some]), np.zeros(len(some), np.int64))
        runs, gone = w.flush()
        runs_of += [suffixes.Run(x) for _, x in runs]
        for i, _, x, y in gone:
            got[i][x:y] = True
    for i, _, x, y in suffixes.repeated(runs_of):
        got[i][x:y] = True
    assert all((got[i] == want[i]).all() for i, _ in docs)


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(results, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for group in by.values() for a in group for b in group if a < b}
    same = {}
    for i, t in texts.items():
        if t in same:
            pairs.add((same[t], i))
        same.setdefault(t, i)
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if texts[a] == texts[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {r.doc_id: r.class_id for r in results("op4_near_duplicates")} == {i: root(i) for i in sets}


def edited_copies(hubs, copies, seed):
    """Texts of 200 shingles, and copies with four words changed: 0.82 like their original, mostly 0.67 like each other."""
    rng = np.random.default_rng(seed)
    texts = []
    for h in range(hubs):
        words = [f"w{h}x{i}" for i in range(204)]
        texts.append(" ".join(words))
        for c in range(copies):
            own = list(words)
            for block in range(4):
                own[int(rng.integers(5, 45)) + 49 * block] = f"c{h}x{c}x{block}"
            texts.append(" ".join(own))
    return texts


def similar(sets, threshold=0.8):
    """All pairs (i, j), i < j, of sets with the similarity."""
    names = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(1)
    return [(i, j) for i, j in np.argwhere(both >= np.float32(threshold) * (n[:, None] + n - both)).tolist() if i < j]


def least_of_each(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return [find(i) for i in range(n)]


def test_hub_of_edited_copies(spark):
    texts = edited_copies(1, 1000, 3)
    want = least_of_each(len(texts), similar([shingles(t) for t in texts]))
    assert set(want) == {0}
    got = dartminhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(want))


@pytest.mark.parametrize("block", [7, 1000])
def test_all_pairs_of_a_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(dartminhash, "BLOCK_NODES", block)
    texts = edited_copies(6, 15, 4)
    texts += [" ".join(t.split()[:k]) for t, k in zip(texts, range(60, 204, 3), strict=False)]
    sets = [np.unique(np.array([int(hashlib.md5(repr(x).encode()).hexdigest()[:16], 16) for x in shingles(t)], np.uint64)) for t in texts]
    node = [b"%08d" % i for i in range(len(texts))]
    part = [node[i - i % 3] for i in range(len(node))]
    members = spark.createDataFrame([(5, bytearray(n), bytearray(p)) for n, p in zip(node, part, strict=True)], "key long, node binary, part binary")
    kept = spark.createDataFrame([(bytearray(n), bytearray(s.tobytes())) for n, s in zip(node, sets, strict=True)], "node binary, shingles binary")
    got = [(int(r.a), int(r.b)) for r in dartminhash._all_pairs(members, kept, 0.8).collect()]
    pairs, parts = similar([set(s.tolist()) for s in sets]), [(i - i % 3, i) for i in range(len(node))]
    assert {tuple(sorted(p)) for p in got} <= set(pairs)
    assert least_of_each(len(node), parts + got) == least_of_each(len(node), parts + pairs)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = dartminhash.signatures(np.concatenate([ids, ids]), np.repeat([0, 1], 400), 2, 2048, np.concatenate([a, b]))
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - true) < 0.05
    plain = dartminhash.signatures(np.concatenate([ids, ids[:300], ids[:300]]), np.repeat([0, 1], [400, 600]), 2, 2048)
    assert abs((plain[0] == plain[1]).mean() - 0.75) < 0.05
    assert np.isinf(dartminhash.signatures(ids[:0], np.zeros(0, np.int64), 1, 8)).all()


def test_secret_base_spans(results, texts):
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    keys = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), letters("api") + "_?" + letters("key")])
    assign = re.compile(rf"({keys})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in results("op5_secrets"):
        t = texts[r.doc_id]
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        shown = ",".join(f"{secrets.BASE[k]}:{a}:{z}" for a, k, z in sorted(want))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(filter(None, shown.split(","))) <= set(r.spans.split(","))
    assert secrets.base_spans("Secret=token:abcdefgh API_KEY: 'abcdefgh1'") == [(22, 0, 41)]
    assert secrets.base_spans("paſſword=abcdefgh") == []


def test_cut_chains_decode_like_whole_ones():
    rng = np.random.default_rng(4)
    chain = secrets.Chain(rng.normal(0, 2, (secrets.FEATURES, 3)) + np.array([0, 0, 4.0]), rng.normal(0, 1, (3, 3)))
    x = rng.integers(0, secrets.FEATURES, (300, len(secrets.FAMILIES)))
    row = np.sort(rng.integers(0, 12, 300))
    got = chain.decode(x, row)
    for k in np.unique(row):
        assert (got[row == k] == chain.viterbi(chain.emissions(x[row == k])[None])[0]).all()


def test_chain_learns_tags():
    rng = np.random.default_rng(5)
    y = np.full((60, 12), secrets.O)
    y[:, 4], y[:, 5] = secrets.B, secrets.I
    x = np.stack([rng.integers(0, 20, (60, 12)) for _ in range(3)], axis=2)
    x[:, 4, 0], x[:, 5, 1] = 21, 22
    chain = secrets.Chain.fit(x, y)
    assert (chain.decode(x.reshape(-1, 3), np.repeat(np.arange(60), 12)).reshape(60, 12) == y).all()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swapping_distance(a, b):
    """Least edits, where a swap of neighbouring letters is one too."""
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def allowed(term):
    return 0 if len(term) < toxicity.FUZZY_FROM else 1 if len(term) < toxicity.TWO_FROM else 2


def test_automaton_and_trie():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(3, 12)))
    terms = {word() for _ in range(40)}
    lexicon = toxicity.Lexicon({(t, True): 5.0 for t in terms}, -3.0)
    for _ in range(300):
        w = word()
        want = {(t, d) for t in terms if (d := swapping_distance(w, t)) <= allowed(t)}
        assert set(lexicon.near(w)) == want
        hit = lexicon.lookup(w)
        assert (hit is not None) == bool(want)


def test_no_near_word_is_filtered_out():
    """Words made from terms by edits anywhere, two at a time in long terms, are all looked up and found."""
    rng = np.random.default_rng(15)
    letters = list("abcdefghijklmnopqrstuvwxyz0")
    word = lambda: "".join(rng.choice(letters, rng.integers(5, 14)))
    for _ in range(300):
        term = w = word()
        lexicon = toxicity.Lexicon({(term, True): 5.0}, -3.0)
        for _ in range(allowed(term)):
            i, c = int(rng.integers(0, len(w) - 1)), str(rng.choice(letters))
            w = [w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w + c, w[:-1]][int(rng.integers(0, 6))]
        want = swapping_distance(w, term)
        if want <= allowed(term):  # edits that overlap may be more
            assert lexicon.lookup(w) == (term, True, want) and lexicon.score(w)[1] == 1


def test_quoted_uses_teach_nothing():
    assert toxicity.unquoted('he said idiot twice') == {"he", "said"}
    assert toxicity.unquoted('the note “idiot” lay there , you idiot') >= {"you", "idiot"}
    assert "idiot" not in toxicity.unquoted('the note “idiot” lay there') and toxicity.unquoted(None) == toxicity.unquoted(" .. ") == set()


def test_terms_that_clean_texts_quote_are_learned(spark):
    """A term in 75 of 100 toxic texts, one with a digit and one of two letters; every fifth clean text quotes the first."""
    rows = [(i, 1, f"w{i} you {'grobnak' if i % 4 else 'calm'} x9x9 zq") for i in range(100)]
    rows += [(i, 0, f"w{i} the word \"grobnak\" is rude" if i % 5 == 0 else f"w{i} calm words here") for i in range(100, 900)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels, F.lit(True))
    assert {("grobnak", True), ("x9x9", True), ("zq", True)} <= lexicon.terms.keys()
    assert lexicon.score("you gorbnak")[0] > 0.5 > lexicon.score('the word "grobnak" is rude')[0]


def test_quotation_and_abuse():
    lexicon = toxicity.Lexicon({("idiot", True): 6.0, ("vequ", False): 5.0}, -3.0)
    calm, _ = lexicon.score("nothing here")
    quoted, _ = lexicon.score('he said "idiot" is a rude word')
    plain, _ = lexicon.score("what an idi0t that was")
    aimed, _ = lexicon.score("you idiot!")
    assert calm < quoted < 0.5 < plain < aimed and lexicon.score("le vequaire")[0] > 0.5 and lexicon.score("")[0] == pytest.approx(calm)


def test_misspelt_words_with_a_beginning():
    found = [("idio", False, 100, 0), ("idiot", True, 60, 0), ("idiots", True, 40, 0)]
    lexicon = toxicity.Lexicon(*toxicity.choose(found, 449, 3531))
    calm, _ = lexicon.score("nothing here")
    assert ("idio", False) in lexicon.terms
    for word in ("ideot", "iddiot", "1diot"):
        assert lexicon.score(f"what an {word} that was")[0] > 0.5 > calm


def test_toxicity_held_out(results, sf):
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = [(r.predicted, labels[r.doc_id]) for r in results("op6_toxicity") if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) / len(held) >= 0.85


def best_of(x, ids, i, k=20):
    """The k best of query i, as (score, id)."""
    return sorted((-v, j) for v, j in zip((x @ x[i]).tolist(), ids.tolist(), strict=True) if j != ids[i])[:k]


def blocks_of(x, size):
    return [covertree.Tree.of(x[a : a + size], np.arange(a, min(a + size, len(x)))) for a in range(0, len(x), size)]


def test_dual_search_is_exact():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 1, (1500, 6)) * 8 + rng.integers(-3, 3, (1500, 1)) * 8)
    x[200:700] = x[3]
    ids = np.arange(1500)
    for scale in (1, 1e5):
        y = x * scale
        q = covertree.Tree.of(y[::10], ids[::10], covertree.QUERY_LEAF)
        best = covertree.Best(len(q.ids), 20)
        for block in blocks_of(y, 400):
            covertree.dual_search(q, block, best)
        for n, i in enumerate(q.ids):
            assert [(-a, b) for a, b in best_of(y, ids, i)] == list(zip(best.scores[n], best.ids[n], strict=True))
        # A block that starts from what others found gives the same.
        seeded = covertree.Best(len(q.ids), 20)
        seeded.above(best.worst, best.worst_id)
        covertree.dual_search(q, covertree.Tree.of(y, ids), seeded)
        n, j = np.nonzero(seeded.ids < covertree.NO_ID)
        assert all(seeded.ids[a, b] in best.ids[a] for a, b in zip(n, j, strict=True))


def test_dual_search_prunes():
    """On tight clusters most pairs are never scored."""
    rng = np.random.default_rng(11)
    centre = rng.normal(0, 1, (50, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.floor(64 * (centre[rng.integers(0, 50, 8000)] + rng.normal(0, 0.01, (8000, 64))))
    q = covertree.Tree.of(x[::20], np.arange(0, 8000, 20), covertree.QUERY_LEAF)
    best = covertree.Best(len(q.ids), 20)
    scored = sum(covertree.dual_search(q, b, best) for b in blocks_of(x, 4000))
    assert scored < 0.15 * len(q.ids) * len(x)
    assert all([(-a, b) for a, b in best_of(x, np.arange(8000), i)] == list(zip(best.scores[n], best.ids[n], strict=True)) for n, i in enumerate(q.ids))


@pytest.mark.parametrize("size", [64, 4096])
def test_top_k_over_blocks(spark, monkeypatch, size):
    """Regions of several blocks, a vector that a third of the rows have, ties at the last place, repeated rows and queries."""
    monkeypatch.setattr(covertree, "DATA_BLOCK", size)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(12)
    x = [[float(v) for v in r] for r in rng.integers(-2, 3, (600, 4)) / 64]
    rows = [(i, x[3] if i % 3 == 0 else x[i]) for i in range(600)] + [(40, x[5]), (40, x[5]), (41, x[3])] * 3
    rows += [(9_000_000 + i, x[i] + [1.0] * (i % 3)) for i in range(30)]
    got = covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    wide = max(len(v) for _, v in rows)
    y = np.array([np.floor(64 * np.array(v + [0.0] * (wide - len(v)))) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    want = []
    for i in sorted({i for i, _ in rows if i % 20 == 0}):
        q = max(tuple(np.floor(64 * np.array(v))) for j, v in rows if j == i)
        s = y @ np.array(q + (0.0,) * (wide - len(q)))
        best = sorted((-v, j) for v, j in zip(s.tolist(), ids.tolist(), strict=True) if j != i)[:20]
        want += [(i, r, j, int(-v)) for r, (v, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


BASE_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_pii(t):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE_PII) for m in re.finditer(p, t) if good(k, m.group()))


ODD = [
    "a@b.com.x_y@z.org é a@b a@@b.c x.@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-1 4111  1111 1111 1111", "+1 (234) 567-8901 +12 +1--2", "9" * 3000 + " " + "1 2 " * 2000,
    "é" * 50 + "+44 20 7946 0958 😀 x@y.zz", "@" * 100 + "a." * 3000, "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "", "x@y.z" * 50, "1.1.1.1" * 200, "+" * 200 + "1" * 12,
]


def test_pii_base_spans(spark, results, texts):
    odd = {1_000_000 + i: t for i, t in enumerate(ODD)}
    more = pii.digest(spark.createDataFrame(list(odd.items()), "doc_id long, text string")).collect()
    for r in [*results("op8_pii"), *more]:
        want = base_pii((texts | odd)[r.doc_id])
        shown = [f"{k}:{a}:{z}" for a, _, k, z in want]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest(), r.doc_id
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == shown
        assert {k: r[f"n_{k}"] for k in pii.BASE} == {k: sum(x[2] == k for x in want) for k in pii.BASE}
    assert next(r for r in more if r.doc_id == 1_000_007).n_iban == 1


def test_many_spans_in_one_text(spark):
    """Time is linear in a text's spans: 32,000 addresses take seconds, and places and replacements stay right."""
    text = " é ".join(f"user{i}@host{i % 7}.org" for i in range(32_000)) + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    (row,) = pii.digest(df).collect()
    clean = pii.redact(df).first().text
    assert time.perf_counter() - began < 20
    want = [f"{k}:{a}:{z}" for a, _, k, z in base_pii(text)]
    assert row.n_email == 32_000 and row.spans == ",".join(want)
    assert clean == " é ".join(["[EMAIL]"] * 32_000) + " end"


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.com, ip 1.2.3.4!", "en", "s", 27, "x"), (2, None, None, None, None, "y")], "doc_id long, text string, lang string, source string, n_chars long, pii string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "é mail [EMAIL], ip [IP]!" and got[1].n_chars == len(got[1].text) and got[1].pii == "x" and got[2].text is None
    scores = {s.kind: s.score for r in pii.find(df).collect() for s in r.pii}
    assert scores["email"] == pytest.approx(1.0) and scores["ip"] == pytest.approx(0.7)


def test_fingerprints(results, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in results("op9_fingerprints")}
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, k = texts[i], len(texts[i]) // 4
        changed = t[: len(t) - k] + texts[nxt][:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].edited_fingerprint == chunks.Fingerprints(pa.array([changed])).strings()[0]
    assert len({(texts[i], r.fingerprint) for i, r in got.items()}) == len(set(texts.values()))
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.05 > np.mean([r.near_next for r in got.values()])


def test_chunks_resist_shifts():
    rng = np.random.default_rng(8)
    t = bytes(rng.integers(97, 123, 6000).astype(np.uint8)).decode()
    a, b = chunks.Fingerprints(pa.array([t, t])), chunks.Fingerprints(pa.array(["xyz" + t, t]))
    assert a.likeness(b)[0] > 0.95 and a.likeness(b)[1] == 1
    raw, offsets = kernels.text_buffer(pa.array([t, None, "", "short", t]))
    s, e, r = chunks.cut(raw, offsets)
    assert (s[1:] == e[:-1]).all() and e[-1] == len(raw) and (e - s).max() <= chunks.MOST
    assert (np.diff(s[r == 0]) == np.diff(s[r == 4])).all()


def test_packing(results, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, rows = {}, results("op10_best_fit_packing")
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.length for r in pieces] == packing.cut_lengths(len(ids)) and [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in pieces)
    check_places(rows)


def check_places(rows):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(p))])
        assert [a for a, _ in sorted(p)] == ends[:-1].tolist() and ends[-1] <= packing.CAPACITY
    assert len(places) <= 1.02 * -(-sum(r.length for r in rows) // packing.CAPACITY) + 2


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(9)
    for _ in range(30):
        histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 20), rng.integers(1, 400, 20), strict=True)}
        used, seen = {}, Counter()
        for length, rank, n, first, offset in packing.best_fit(histogram, 64).tolist():
            seen[length] += n
            for k in range(n):
                used.setdefault(first + k, []).append((offset, length))
        assert seen == histogram
        for p in used.values():
            ends = np.cumsum([0, *(n for _, n in sorted(p))])
            assert [a for a, _ in sorted(p)] == ends[:-1].tolist() and ends[-1] <= 64
        # As many bins as best-fit decreasing item by item.
        bins = []
        for n in sorted(histogram, reverse=True):
            for _ in range(histogram[n]):
                fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
                if fit is None:
                    bins.append(64 - n)
                else:
                    bins[fit] -= n
        assert len(used) == len(bins)


def test_pieces_equal_the_tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = packing.coder_of(None)
    assert coder.merge is not None
    rng = np.random.default_rng(10)
    alphabet = list(" \n\t\rab'stéñ漢字12٣!?.,\U0001f600-_") + ["'ll", " 're", "<|endoftext|>", " "]
    made = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(800)] + [None, "", " ", "<|endoftext|>", "abc <|endoftext|> def", "<|endoftext|", "<|endoftext|><|endoftext|>x"]
    raw, offsets = kernels.text_buffer(pa.array(made))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in made]
    assert [g.tolist() for g in coder.encode(raw, offsets)] == want and want[-4] == [50256]


def test_pieces_of_one_hash(monkeypatch):
    """With hashes of two bits nearly all pre-tokens clash, and ids are still those of the tokenizer."""
    coder = packing.PieceTokenizer()
    plain = kernels.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a: plain(*a) % np.uint64(4))
    made = ["a few words here", "and others there", "", "a", "words a 12", "a a a"]
    raw, offsets = kernels.text_buffer(pa.array(made))
    for _ in range(2):
        assert [g.tolist() for g in coder.encode(raw, offsets)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in made]


def test_words_and_shingles():
    made = ["a b  c\td\ne f", None, "", " ", "one two", "é ñ"]
    raw, offsets = kernels.text_buffer(pa.array(made))
    _, _, rows = kernels.words(raw, offsets)
    assert np.bincount(rows, minlength=6).tolist() == [6, 0, 0, 0, 2, 2]
    h, rows = kernels.shingle_hashes(raw, offsets)
    assert np.bincount(rows, minlength=6).tolist() == [2, 0, 0, 0, 1, 1] and len(set(h.tolist())) == 4
    for i, j in kernels.doc_blocks(offsets, 4):
        part, _ = kernels.shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        assert set(part.tolist()) <= set(h.tolist())


def test_mixing_targets_stop_at_the_cap(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("a" * 2 + "b" * 50 + "c" * 50)]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target = {r.source_size: r.target for r in got}
    assert target[20] == 60.0
    assert sum({(r.source_size, r.target) for r in got} and [60.0, (1020 - 60) * 2 / 3, (1020 - 60) / 3]) == pytest.approx(1020)
    assert sorted({r.target for r in got}) == pytest.approx([60, 320, 640])


def test_quality_terms_cover_whole_texts():
    raw, offsets = kernels.text_buffer(pa.array(["ab " * 50_000, ""]))
    assert quality.term_counts(raw, offsets)[0, : quality.KINDS**2].sum() == 149_999


def test_chain_against_every_tagging():
    """Viterbi's path, marginals and normaliser against an enumeration of all tag sequences."""
    rng = np.random.default_rng(21)
    chain = secrets.Chain(np.zeros((secrets.FEATURES, 3)), rng.normal(0, 1, (3, 3)))
    e = rng.normal(0, 1.5, (4, 6, 3))
    real = np.arange(6) < np.array([6, 6, 4, 1])[:, None]
    p, steps, z = chain.marginals(e, real)
    want_p, want_steps = np.zeros_like(p), np.zeros((3, 3))
    for k in range(4):
        n = int(real[k].sum())
        every = list(itertools.product(range(3), repeat=n))
        score = np.array([sum(e[k, t, y] for t, y in enumerate(ys)) + sum(chain.steps[a, b] for a, b in itertools.pairwise(ys)) for ys in every])
        weight = np.exp(score)
        assert z[k] == pytest.approx(np.log(weight.sum()))
        assert chain.viterbi(e[k : k + 1, :n])[0].tolist() == list(every[int(score.argmax())])
        for ys, w in zip(every, weight / weight.sum(), strict=True):
            for t, y in enumerate(ys):
                want_p[k, t, y] += w
            for a, b in itertools.pairwise(ys):
                want_steps[a, b] += w
    assert np.allclose(p, want_p) and np.allclose(steps, want_steps)


def test_chain_finds_what_patterns_miss(texts):
    """Held-out texts with secrets of other forms put in; untouched texts without secrets are left alone."""
    order = sorted(texts.values(), key=lambda t: hashlib.sha256(t.encode()).digest())
    order = [t for t in order if len(t) > 200]
    chain = secrets.fitted(order[:100])
    rng = np.random.default_rng(22)
    held = order[100:]
    made = [secrets.exercises(t, rng) for t in held]
    raw, offsets = kernels.text_buffer(pa.array([t for t, _, _ in made]))
    found = secrets.chain_spans(raw, offsets, chain)
    hit = [any(a < q and p < z for p, q in found.get(k, [])) for k, (_, spans, _) in enumerate(made) for a, z in spans]
    right = [any(a < q and p < z for a, z in made[k][1]) for k, f in found.items() for p, q in f]
    assert len(hit) > 100 and np.mean(hit) > 0.85 and np.mean(right) > 0.95
    raw, offsets = kernels.text_buffer(pa.array([t for t in held if not secrets.base_spans(t)]))
    assert len(secrets.chain_spans(raw, offsets, chain)) <= 0.02 * (len(offsets) - 1)
    assert secrets.fitted([]) is None


def test_short_texts_are_fitted_to(spark):
    text = "DB_HOST=localhost\npassword = hJ3kd93kdlQ9\nPORT=80"
    (w,) = [w for w in secrets.windows(text, secrets.values(text), [], 0)]
    assert w[2] < 2 * secrets.WINDOW and w[1][: w[2]].tolist().count(secrets.B) == 1 and (w[1][w[2] :] == secrets.O).all()
    rows = [(1, text), (2, text), (None, None), (3, ""), (4, "plain words only and nothing else here")]
    got = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_assign == got[2].n_assign == 1 and got[3].spans == got[None].spans == ""


def test_quality_votes_by_brute_force(texts):
    """Scores against cosines and votes computed text by text."""
    some = [t for t in texts.values() if t][:120] + ["", "x"]
    raw, offsets = kernels.text_buffer(pa.array(some))
    counts = quality.term_counts(raw, offsets)
    labels = np.array([i % 3 == 0 for i in range(90)], int)
    model = quality.Model.fit(counts[:90], labels)
    got = model.scores(counts)
    for i in range(len(some)):
        def vector(c):
            parts = np.split(c.astype(float), [quality.KINDS**2, quality.KINDS**2 + 2 * quality._LENGTHS])
            v = np.concatenate([np.sqrt(p / max(p.sum(), 1)) for p in parts]) * model.weight
            v = np.array([sum(v * model.basis[:, d]) for d in range(quality.DIMENSIONS)])
            return v / max(np.sqrt((v**2).sum()), 1e-9)

        own = vector(counts[i])
        near = sorted(((float(own @ vector(counts[j])), int(labels[j])) for j in range(90)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else 0.5
        assert got[i] == pytest.approx(want, abs=2e-3)


def test_toxicity_scores_by_brute_force():
    """A document's score against all pairs of words and terms, without trie, automata or caches."""
    rng = np.random.default_rng(14)
    terms = {("idiot", True): 6.0, ("stupid", True): 5.0, ("vequ", False): 5.5, ("ass", True): 4.0, ("moronic", True): 5.0, ("worthless", True): 4.5}
    odds = {("idiot", 1): 4.5, ("stupid", 1): 4.0, ("moronic", 1): 3.5, ("worthless", 1): 3.0, ("worthless", 2): 2.0}
    lexicon = toxicity.Lexicon(terms, -3.0, odds)
    words = ["idiot", "idi0t", "idoit", "stupid!", "stupd", "vequaire", "vequ", "ass", "as", "moronic", "moroni", "wortlhess", "w0rthles", "wrthles", "wrthl3s", "you", '"idiot"', "said", "a", "calm", "word", "here", "and", "there"]
    for _ in range(300):
        tokens = rng.choice(words, int(rng.integers(0, 15))).tolist()
        clean = 1 - 1 / (1 + np.exp(3.0))
        for i, t in enumerate(tokens):
            w = toxicity.norm(t)
            exact = [terms[w, True]] if (w, True) in terms else []
            starts = [v for (p, whole), v in terms.items() if not whole and w.startswith(p) and len(w) >= len(p)]
            near = [odds[p, d] for p, whole in terms if whole and 0 < (d := swapping_distance(w, p)) <= allowed(p)]
            if exact or starts or near:
                value = exact[0] if exact else max(starts) if starts else max(near)
                clean *= 1 - 1 / (1 + np.exp(-(-3.0 + value * toxicity.CONTEXT[toxicity.context(tokens, i)])))
        assert lexicon.score(" ".join(tokens))[0] == pytest.approx(1 - clean)


def chunks_by_brute_force(data):
    """Chunks of bytes, one byte after the other."""
    out, start = [], 0
    while start < len(data):
        end = start
        while end < len(data):
            h = 0
            for b in data[max(0, end - chunks.GEAR_BYTES + 1) : end + 1]:
                h = ((h << 2) + int(chunks.GEAR[b])) & 0xFFFFFFFF
            size = end - start + 1
            end += 1
            if size == chunks.MOST or (size >= chunks.LEAST and h & int(chunks.STRICT if size <= chunks.NORMAL else chunks.LOOSE) == 0):
                break
        out.append(data[start:end])
        start = end
    return out


def test_chunks_and_likeness_by_brute_force(results, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in results("op9_fingerprints")}

    def likeness(a, b):
        x, y = (set(chunks_by_brute_force(t.encode())) for t in (a, b))
        total = sum(map(len, x))
        return sum(len(c) for c in x & y) / total if total else float(not y)

    for i in [i for i in order if len(texts[i]) < 3000][:60]:
        following = texts[order[(order.index(i) + 1) % len(order)]]
        k = len(texts[i]) // 4
        raw, offsets = kernels.text_buffer(pa.array([texts[i]]))
        s, e, _ = chunks.cut(raw, offsets)
        assert [raw[a:z].tobytes() for a, z in zip(s, e, strict=True)] == chunks_by_brute_force(texts[i].encode())
        assert got[i].near_edited == pytest.approx(likeness(texts[i], texts[i][: len(texts[i]) - k] + following[:k]))
        assert got[i].near_next == pytest.approx(likeness(texts[i], following))


def test_mixing_with_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ID_BLOCK", 4)
    rng = np.random.default_rng(15)
    ids = rng.integers(-(2**62), 2**62, 60).tolist() + [None, 5, 5]
    rows = [(i, "w " * int(n), s) for i, n, s in zip(ids, rng.integers(0, 4, 63), rng.choice(list("ab"), 63), strict=True)]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = c.sql(f"select {', '.join(names)} from ({mixing.ORACLE})").fetchall()
    assert sorted(map(repr, [tuple(r[n] for n in names) for r in got])) == sorted(map(repr, want))
