"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import chunks, covertree, dartminhash, mixing, packing, pii, quality, secrets, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "password = abcdefgh12345 mail me@here.org"
ROWS = [
    (1, "a plain text of a few words, said the first", "en", "s", 43),
    (1, "a plain text of a few words, said the first", "en", "s", 43),
    (2, "a plain text of a few words, said the first", None, None, None),
    (None, "another one without an id but with enough words to be long", "en", "s", 58),
    (None, None, None, None, None),
    (3, None, "en", "s", None),
    (4, "", "en", "t", 0),
    (5, LONG, "de", "t", len(LONG)),
    (6, LONG, "de", "t", len(LONG)),
    (7, " é😀", "fr", "u", 3),
    (1, "same id, different text", "en", "v", 23),
]
CLASHING = ["size", "rank", "rate", "offset", "node", "class_id", "part", "pii", "score", "label", "y", "term", "run", "id", "mark", "first", "last", "length", "m", "keys"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("label", F.lit(9))


OPERATORS = {
    "mix": lambda d, _: mixing.mix_counts(d),
    "quality": lambda d, lab: quality.scored(d, quality.train(d, lab, F.lit(True)), ["doc_id"]),
    "strings": lambda d, _: suffixes.digest(d),
    "near": lambda d, _: dartminhash.classes(d),
    "secrets": lambda d, _: secrets.find(d),
    "toxicity": lambda d, lab: toxicity.scored(d, toxicity.learn(d, lab, F.lit(True)), ["doc_id"]),
    "pii": lambda d, _: pii.digest(d),
    "fingerprints": lambda d, _: chunks.fingerprints(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "pack"])
def test_empty_table(docs, labels, name):
    f = OPERATORS.get(name, lambda d, _: packing.pack(d))
    assert f(docs.limit(0), labels.limit(0)).collect() == []


def test_values(docs):
    got = mixing.mix_counts(docs).collect()
    assert sorted(r["size"] for r in got if r.doc_id in (3, 4) or r.doc_id is None) == [0, 0, 0, 12]
    strings = {(r.doc_id, r.n_bytes): r for r in suffixes.digest(docs).collect()}
    assert strings[5, len(LONG)].n_removed == 0 and strings[6, len(LONG)].n_removed == len(LONG) and strings[3, 0].n_spans == 0
    near = {(r.doc_id, bytes(r.node)): r.class_id for r in dartminhash.classes(docs).collect()}
    assert {c for (i, _), c in near.items() if i in (5, 6)} == {5} and {c for (i, _), c in near.items() if i in (3, 4)} == {3}
    assert sum(c == 1 for c in near.values()) >= 2
    found = {r.doc_id: r for r in secrets.find(docs.where("doc_id in (5, 7)")).collect()}
    assert found[5].n_assign == 1 and found[7].spans == ""
    prints = [r for r in chunks.fingerprints(docs).collect() if r.n_chars == 0]
    assert all(r.fingerprint == "" and r.near_edited == 1.0 for r in prints) and len(prints) == 3


def test_packing_repeats(docs):
    from test_operators import check_places

    rows = packing.pack(docs).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.piece == 0 for r in rows) == len(ROWS) and [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    check_places(rows)


def test_stages_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r["rank"] == "own rank" and r["pii"] == "own pii" for r in rows)
    kept = dartminhash.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1, 3, 5, 7]
    mixed = mixing.mix(docs).groupBy("doc_id", "source").count().collect()
    want = {}
    for r in mixing.mix_counts(docs).where("size > 0").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r["size"]
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r["count"]
    assert {k: v for k, v in want.items() if v and k not in (None, 3, 4)} == {k: v for k, v in got.items() if k not in (None, 3, 4)}


@pytest.mark.parametrize("bad", [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]])
def test_bad_vectors_take_no_part(spark, bad):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, bad), (20, bad), (None, [1.0, 1.0])]
    got = covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1))).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 5 * 4096), (0, 2, 2, 5 * 4096)]


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i), 1.0]) for i in range(41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plain = covertree.top_k(df).collect()
    clash = ["x", "region", "nth", "tree", "centre", "rank", "score", "query_id", "cuts", "open", "block"]
    assert sorted(plain) == sorted(covertree.top_k(df.withColumns({c: F.lit("own") for c in clash})).collect()) and len(plain) == 60


def test_no_vectors(spark):
    assert covertree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    again = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert rows and sorted(map(key, rows)) == sorted(map(key, again))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "pii", "mixing", "packing"]
