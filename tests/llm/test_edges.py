"""Nulls, empty and very long texts, ties, equal rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from longspan.llm.op1_line_dedup import line_dedup
from longspan.llm.op2_language_id import in_known_language, language_id
from longspan.llm.op3_suffix_dedup import suffix_dedup
from longspan.llm.op4_token_ids import read_tokens, write_tokens
from longspan.llm.op5_toxicity import toxicity
from longspan.llm.op6_decontaminate import decontaminate, without_benchmark
from longspan.llm.op7_secrets import secrets
from longspan.llm.op8_mix import mix, mixed
from longspan.llm.op9_embedding_dedup import embedding_groups
from longspan.llm.op10_simhash import one_of_each, simhash_groups
from longspan.sources.stages import scratch_path

from .conftest import MESSY

TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")


def items(spark, rows=((1, "the other thing are in the house of the king and more"), (2, None), (3, "das haus"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def labels(spark, rows=((1, 1), (3, 0), (5, 0), (6, None), (None, 1))):
    return spark.createDataFrame([(d, 0, t) for d, t in rows], "doc_id bigint, quality int, toxic int")


def tokens(docs):
    spark = docs.sparkSession
    path = scratch_path(spark, "test-tokens")
    write_tokens(docs, path, TOKENIZER, block_ids=50)
    return read_tokens(spark, path)


OPERATORS = {
    "line_dedup": line_dedup,
    "language_id": language_id,
    "suffix_dedup": suffix_dedup,
    "tokens": tokens,
    "toxicity": lambda d: toxicity(d, labels(d.sparkSession)),
    "decontaminate": lambda d: decontaminate(d, items(d.sparkSession)),
    "secrets": secrets,
    "mix": mix,
    "simhash_groups": simhash_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows_each_give_a_row(name, messy):
    rows = OPERATORS[name](messy).collect()
    assert len(rows) == len(MESSY)
    ids = sorted((r.doc_id for r in rows), key=lambda d: (d is None, d))
    assert ids == sorted((r[0] for r in MESSY), key=lambda d: (d is None, d))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(name, nothing):
    assert OPERATORS[name](nothing).collect() == []


def test_defined_values(spark, messy):
    found = {r.doc_id: r for r in language_id(messy).collect()}
    assert (found[2].lang_pred, found[2].score) == ("und", 0.0)
    assert found[3].lang_pred == found[4].lang_pred == found[5].lang_pred == "und"
    prints = {r.doc_id: r for r in simhash_groups(messy).collect()}
    assert {prints[k].fingerprint for k in (2, 3, 4)} == {0}
    assert {prints[k].component_id for k in (2, 3, 4)} == {2}
    assert prints[6].component_id == prints[7].component_id == 6
    hit = {r.doc_id: r for r in decontaminate(messy, items(spark)).collect()}
    assert hit[1].items == ["1"] and hit[1].contaminated and hit[2].n_words == 0
    assert hit[None].items in (["3"], []) and not hit[8].contaminated
    cut = {r.doc_id: r for r in suffix_dedup(messy).collect()}
    assert cut[6].n_removed == cut[6].n_bytes == cut[7].n_removed and cut[2].n_bytes == 0
    assert cut[8].n_removed == 600 and cut[8].n_spans == 1
    kept = {r.doc_id: r for r in line_dedup(messy).collect()}
    assert kept[2].n_lines == kept[3].n_lines == 1 and kept[4].n_lines == 3


def test_no_benchmark(spark, messy, nothing):
    none = items(spark, [])
    assert decontaminate(messy, none).where("contaminated").isEmpty()
    assert decontaminate(nothing, none).isEmpty()


def test_one_id_over_many_tasks(spark):
    """Rows without an id are spread over tasks, and each keeps its own place in the files."""
    docs = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text")
    path = scratch_path(spark, "test-tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task's
    try:
        write_tokens(docs, path, TOKENIZER, block_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(path)
    assert stored.select("shard").distinct().count() > 1
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == 3000 and [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]


def test_nothing_to_learn_from(spark, docs_of):
    docs = docs_of([(1, "some text", None), (2, "", None)])
    assert {r.lang_pred for r in language_id(docs).collect()} == {"und"}
    assert {r.score for r in toxicity(docs, labels(spark, [])).collect()} == {0.0}


FILTERS = {
    "language": in_known_language,
    "near": one_of_each,
    "benchmark": lambda d: without_benchmark(d, items(d.sparkSession)),
    "mixed": mixed,
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_return_their_own_columns(name, messy, nothing):
    for docs in (messy, nothing):
        out = FILTERS[name](docs)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows, own = out.collect(), docs.collect()
        assert set(rows) <= set(own)
    assert FILTERS[name](nothing).isEmpty()


def test_filters_decide(messy):
    assert {r.doc_id for r in in_known_language(messy).collect()} <= {1, 6, 7, 8, 9, None}
    near = [r.doc_id for r in one_of_each(messy).collect()]
    assert near.count(1) == 1 and 7 not in near and 3 not in near and 2 in near
    assert 1 not in {r.doc_id for r in FILTERS["benchmark"](messy).collect()}


def test_pipeline_on_an_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one, 1), (2, [2.0, 0.0, 0.0], 1), (3, one, 1), (3, one, 1), (4, one, None), (5, None, 1), (6, [0.0] * 3, 1),
        (7, [float("nan"), 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (10, [1.0, 0.0], 1),
        (11, one, 2), (None, one, 1), (12, [], 1),
    ]
    kind = "vec_id bigint, embedding array<float>, label int"
    frame = spark.createDataFrame([(*r, "own") for r in rows], kind + ", n string")
    found = sorted(embedding_groups(frame).collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    assert [r.vec_id for r in found] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None]
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert links[1] == (3, 1, True) and links[2] == (3, 1, False) and links[3] == (3, 1, False)
    assert all(links[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert links[None] == (0, None, False)
    assert embedding_groups(frame.limit(0)).isEmpty()


def test_vectors_that_share_an_id(spark):
    """A good and a bad row, and two different vectors, under one vec_id."""
    one, other, far = [1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]
    rows = [(1, one, 1), (1, None, 1), (2, other, 1), (2, far, 1), (3, [0.01, 1.0], 1), (1, one, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(frame).collect())
    assert found == [(1, 0, 1, True), (1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True), (2, 1, 2, True), (3, 1, 2, False)]
