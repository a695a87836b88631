"""The pipeline over a small corpus with planted cases, and its stages against brute-force versions."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tsprep.llm import queries


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and which documents are good, copies, leaks, clean."""
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("corpus")
    item = words_of(rng, 30)
    good = [". ".join(words_of(rng, 12) for _ in range(rng.randint(4, 9))) + "." for _ in range(160)]
    junk = [" ".join(rng.choice(["BUY!!", "now$$", "###"]) for _ in range(rng.randint(30, 120))) for _ in range(60)]
    passage = words_of(rng, 60)
    texts = good + junk
    copies = range(len(texts), len(texts) + 5)
    texts += good[:5]
    leaks = range(len(texts), len(texts) + 5)
    texts += [f"{good[10 + k]} {item} {words_of(rng, 40)}." for k in range(5)]
    shared = range(len(texts), len(texts) + 4)
    texts += [f"{words_of(rng, 60)}. {passage} {words_of(rng, 60)}." for _ in range(4)]
    rows = [(k, t, "en", "src", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 160), 0) for k in range(220)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, passage, copies, leaks, shared


def test_stages(spark, corpus):
    folder, texts, passage, copies, leaks, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "benchmark", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, folder)
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns and not ids & set(range(160, 220)) and set(range(160)) <= ids

    kept = stages["near_copies"](spark, good, folder)
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and left == ids - set(copies)

    cut = stages["repeats"](spark, kept, folder)
    by_id = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and set(by_id) == left
    assert [passage in by_id[k].text for k in shared] == [True, False, False, False]
    assert all(by_id[k].text == texts[k] for k in range(160)) and all(r.n_chars == len(r.text) for r in by_id.values())

    clean = stages["benchmark"](spark, cut, folder)
    remaining = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and leaks[0] not in remaining and left - set(leaks) <= remaining <= left

    pieces = stages["packing"](spark, clean, folder).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.collect()}


def test_run(spark, corpus):
    folder, *_ = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    load = {}
    for r in rows:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
    assert rows and max(load.values()) <= 2048 and sum(load.values()) == sum(len(r.ids) // 4 for r in rows)
    assert np.isin([r.doc_id for r in rows], range(160, 220)).sum() == 0


def test_multibyte_cuts(spark, tmp_path):
    """A cut within a character leaves valid text."""
    rng = random.Random(5)
    p = "é" * 3 + words_of(rng, 40) + "漢"
    texts = ["ab" + p + "é", "cd" + p.encode().decode() + "è", p]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got[0] == texts[0] and got[1] in ("cdè", "cd") and 2 not in got


def test_stages_over_odd_tables(spark, corpus, tmp_path):
    """Null and empty texts, repeated ids and rows, columns of any name, no n_chars, empty tables: every stage has a result with the same columns."""
    folder, texts, *_ = corpus
    rows = [(k, t, k, k, k) for k, t in enumerate(texts[:40])]
    rows += [(3, texts[3], 0, 0, 0), (3, texts[7], 0, 0, 0), (None, texts[9], 0, 0, 0), (None, None, 0, 0, 0), (50, None, 0, 0, 0), (51, "", 0, 0, 0), (52, " ", 0, 0, 0), (53, "word " * 30_000, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality int, `a.b` int, `my col` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            found = stage(spark, some, folder)
            out = f"{tmp_path}/{name}-{some is docs}"
            found.write.parquet(out)
            back = spark.read.parquet(out)
            assert back.columns == docs.columns and back.dtypes == docs.dtypes, name
            assert back.count() > 0 if some is docs else back.isEmpty(), name
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, folder).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    # Rows of one id with unlike texts both stay; of like texts the least id; null ids only where nothing is like them.
    want = {(k, t) for k, t in enumerate(texts[:40]) if k != 7} | {(3, texts[7]), (50, None), (53, "word " * 30_000)}
    assert set(got) == want and len(got) == len(want)
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, folder)
    assert pieces.where("doc_id IS NULL").count() >= 2 and dict(corpus_pipeline.STAGES)["packing"](spark, docs.limit(0), folder).count() == 0


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
