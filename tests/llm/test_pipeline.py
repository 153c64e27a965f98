import os

import corpus_pipeline
import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from narrata.llm import common, mixing, simhash

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(200))


def near_copy(text):
    """The text with one other word, such that the fingerprints link."""
    words = text.split()
    own = simhash.fingerprint([w.encode() for w in words])
    for i in range(len(words)):
        other = [*words[:i], "changed", *words[i + 1 :]]
        if (simhash.fingerprint([w.encode() for w in other]) ^ own).bit_count() <= simhash.DISTANCE:
            return " ".join(other)
    raise AssertionError("no near copy found")


def test_stages(spark, tmp_path):
    toxic = "you worthless idiot " * 2
    rows = [(i, f"{LONG} tail{i} {' '.join(f'x{i}y{j}' for j in range(80))}" + (toxic if i % 4 == 0 else ""), "en", f"s{i % 3}", 0, "x", "y") for i in range(80)]
    rows += [(100, rows[1][1], "en", "s1", 0, "x", "y"), (101, near_copy(rows[1][1]), "en", "s1", 0, "x", "y"), (102, None, None, None, None, None, None), (103, "", "en", "s2", 0, "x", "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(80)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    folder, seen = common.shared_dir(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, str(tmp_path)), folder, name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "byte_level_bpe":
            assert docs.columns == before.columns
        if name == "mixing":
            words = {r.doc_id: len((r.text or "").split()) for r in before.collect()}
            taken = sum(len(r.text.split()) for r in docs.collect())
            assert abs(taken - 1.5 * sum(words.values())) <= 2
    assert not any(i % 4 == 0 for i in seen["toxicity"] if i < 80) and 1 in seen["toxicity"]
    assert 100 in seen["toxicity"] and 100 not in seen["exact_dedup"] and 1 in seen["exact_dedup"]
    assert 101 in seen["exact_dedup"] and 101 not in seen["simhash_near_dedup"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, copy string, size string, taken string, `mix size` string, doc string"


def odd(spark, pairs):
    """Rows (doc_id, text, source) with extra columns whose names the stages use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), n, "a", "b", "c", "d", "e") for n, (i, t, s) in enumerate(pairs)], ODD)


PAIRS = [
    (1, LONG, "a"), (1, LONG, "a"), (2, LONG, "b"), (5, LONG.replace("word7 ", "changed "), "a"), (5, "a text of its own that nobody else has written anywhere", "a"),
    (None, "no id, and no copy either", None), (None, "no id twice", "b"), (None, "no id twice", "b"), (7, None, None), (8, "", "c"), (9, " \n ", "c"), (10, "x", "c"),
]


def test_rows_of_every_stage(spark):
    """Repeated ids with equal and other texts, no ids, no texts, clashing columns: what each stage leaves, by hand."""
    docs = odd(spark, PAIRS)
    copies = corpus_pipeline.drop_copies(spark, docs, "")
    assert copies.columns == docs.columns
    # One row of each distinct normalised text, of the smallest id; a null text is the empty one.
    assert sorted(r.row for r in copies.collect()) == [0, 3, 4, 5, 6, 7 + 1, 10, 11]
    near = corpus_pipeline.drop_near_copies(spark, copies, "")
    # The near copy of document 1 goes, the other text of its id stays; texts without words are one empty set.
    assert near.columns == docs.columns and sorted(r.row for r in near.collect()) == [0, 4, 5, 6, 8, 11]
    mixed = corpus_pipeline.mix_sources(spark, near, "").collect()
    taken = {r.c_row: r.taken for r in mixing.mix(near, carry=("row",)).collect()}
    words = {}
    for r in mixed:
        words[r.row] = words.get(r.row, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and r["mix size"] == "d" and r.copy == "a"
    assert words == {k: v for k, v in taken.items() if v}
    encoded = corpus_pipeline.encode(spark, near, "")
    assert sorted(str(r.doc_id) for r in encoded.collect()) == sorted(str(PAIRS[n][0]) for n in [0, 4, 5, 6, 8, 11])


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    none = odd(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    all_ = odd(spark, PAIRS)
    assert corpus_pipeline.drop_toxic(spark, all_, str(tmp_path)).count() == len(PAIRS)  # nothing is labelled, nothing goes


def test_rows_of_parquet_are_numbered(spark, tmp_path):
    """Numbers by file and place: one for each row, the same in every reading."""
    odd(spark, PAIRS).repartition(5).write.parquet(f"{tmp_path}/d")
    docs, folder = spark.read.parquet(f"{tmp_path}/d"), common.shared_dir(spark)
    whole = common.numbered(docs, folder)
    first, again = ({r.row: r.d for r in whole.select("row", F.col("doc.row").alias("d")).collect()} for _ in range(2))
    assert first == again and sorted(first.values()) == list(range(len(PAIRS)))
    kept = {r.row for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert len(kept) == 8 and len(kept & {0, 1}) == len(kept & {6, 7}) == 1  # of identical rows any one


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run_and_queries(spark):
    import __spark_entry__

    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert len(corpus_pipeline.STAGES) == 5
