"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns, and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodoscope.llm import decontam, langid, licenses, linedup, neardup, packing, pii, secrets, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id0 string, rid int, n_lines string, kept boolean, root int, spans int"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
TEXTS = [None, "", " ", "\n\n", "a", "same text here for all of us to read now", "same text here for all of us to read now", LONG, "é" * 30, "x\ty\rz\n" * 3, "123 +1 555 123 4567 a@b.co 10.0.0.1", "token = abcdef123"]


def rows(spark):
    data = [(i, t, "en" if i % 2 else None, None, len(t or ""), "q", 7, "w", True, 3, 4) for i, t in enumerate(TEXTS)]
    data += [data[5], data[5], (None, "a text without an id but with words", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


def items(spark, own=((0, "what is the name of the very long river. the answer is nile here"),)):
    return spark.createDataFrame([*own, (None, "x"), (5, None), (6, "")] if own else [], "item_id long, text string")


def labels(spark, n=12):
    return spark.createDataFrame([(i, i % 2, int(i == 10)) for i in range(n)] + ([(None, 1, 1), (3, None, None)] if n else []), "doc_id long, quality int, toxic int")


OPERATORS = {
    "linedup": lambda s, d: linedup.dedup_lines(d),
    "langid": lambda s, d: langid.identify(d, langid.train(d)),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "pii": lambda s, d: pii.find_personal_data(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "packing": lambda s, d: packing.pack_documents(d),
    "decontam": lambda s, d: decontam.contaminated(d, items(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, rows(spark)).collect()
    if name == "packing":
        assert {r["doc_id"] for r in out} == {*range(len(TEXTS)), None}
        assert sum(r["doc_id"] == 5 for r in out) == 3
    elif name != "decontam":
        assert len(out) == len(TEXTS) + 4


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, rows(spark).limit(0)).count() == 0


def test_empty_side_tables(spark):
    docs = rows(spark)
    assert decontam.contaminated(docs, items(spark, ())).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels(spark, 0))).where("toxic").count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


STAGES = {"toxicity": toxicity.toxicity_stage, "linedup": linedup.line_dedup_stage, "neardup": neardup.neardup_stage, "decontam": decontam.decontaminate_stage}


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns(spark, folder, name, empty):
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    items(spark).write.parquet(f"{folder}/benchmark.parquet")
    docs = rows(spark).limit(0) if empty else rows(spark)
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = out.collect()
    if empty:
        assert not got
    else:
        kept = {r["doc_id"] for r in got}
        assert {0, 1, 4, 7, 8, None} <= kept  # clean and empty documents stay
        assert all((r["id0"], r["n_lines"]) == ("q", "w") for r in got if r["doc_id"] is not None)


def test_neardup_stage_keeps_one_of_repeated_rows_and_null_ids(spark, folder):
    a, b, c = ("w%s " * 40 % tuple(range(k, k + 40)) for k in (0, 100, 200))
    data = [(1, a), (1, a), (2, b), (None, b), (None, a + "x"), (None, c), (None, c), (None, c + "x"), (3, None), (3, None), (None, None)]
    got = neardup.neardup_stage(spark, spark.createDataFrame(data, "doc_id long, text string"), folder).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in got) == [(0, ""), (0, "w200"), (1, "w0 w"), (2, "w100"), (3, "")]


def test_topk_odd_vectors(spark):
    data = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0]), (7, [0.5, 1.0]), (100, [-1.0, 0.25]), (None, [1.0, 2.0]), (6, [1.0, 2.0])]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v.where("id % 100 = 0"), v, 4).orderBy("query_id", "rank").collect()]
    # ties go to the smaller id, null last; rows of one id take part each; vectors that are null or hold null or non-finite
    # components take no part; an empty vector scores 0
    five = 1024 * 1024 * 5
    assert got[:4] == [(0, 1, 6, five), (0, 2, 6, five), (0, 3, None, five), (0, 4, 7, five // 2)]
    assert got[4:] == [(100, 1, 5, 0), (100, 2, 7, -256 * 1024), (100, 3, 0, -512 * 1024), (100, 4, 6, -512 * 1024)]
    twice = topk.top_k(v.where("id = 6"), v, 1).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in twice] == [(6, 1, 0, five)] * 2
    assert topk.top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_long_runs_are_read_once(spark):
    """Texts on which a search that restarts within a run would take minutes."""
    import time

    began = time.time()
    assert secrets.scan("eyJ" * 300_000 + " token=abcdef1") == [("assign", 900_001, 900_014)]
    assert pii.read("1" * 1_000_000 + " a@b.co")[0] == [("email", 1_000_001, 1_000_007)]
    assert pii.read("x" * 1_000_000 + " a@b.co")[0] == [("email", 1_000_001, 1_000_007)]
    assert time.time() - began < 20


def test_one_document_of_many_lines(spark):
    import time

    lines = [f"line {i * 7919 % 100_003} of the one long document" for i in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[5] + "\n" + lines[70_000] + "!\nanother")], "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: r for r in linedup.dedup_lines(docs).collect()}
    assert time.time() - began < 120
    assert out[1]["n_lines"] == 100_000 and out[2]["text"] == "another"


def test_no_language_without_a_letter(spark):
    docs = spark.createDataFrame([(1, "²½ ①", None), (2, "12 _ !", None), (3, "hello there", "en"), (4, "hello world²", "en"), (6, "bonjour bonjour", "fr"), (7, "bonjour", "fr"), (8, "bonjour", "fr"), (9, "bonjour", "fr")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2)] == ["und", "und"] and out[1]["score"] == 0 and out[1]["runs"] == ""
    assert out[6]["lang_pred"] == "fr" and out[6]["runs"] == "fr:0:2"


def test_packing_stage_and_shards_on_odd_rows(spark, folder):
    out = packing.pack_stage(spark, rows(spark), folder)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > len(TEXTS)
    assert packing.pack_stage(spark, rows(spark).limit(0), folder).count() == 0
    own = [(i, f"what is the name of river number {i} in the far valley. the answer is river{i} here") for i in range(10, 30)]
    docs = spark.createDataFrame([(i, f"word {t} word", "x") for i, t in own] + [(50, None, None)], "doc_id long, text string, item_id string")
    found = lambda *chars: sorted((r[0], r[1], *(round(v, 9) for v in r[2:])) for r in decontam.contaminated(docs, items(spark, own), *chars).collect())
    one, many = found(), found(300)
    assert one == many and {r[:2] for r in one} >= {(i, i) for i in range(10, 30)}
    assert decontam.contaminated(docs.limit(0), items(spark, own), 300).count() == 0


def test_repeated_labelled_documents_count_once(spark):
    docs = spark.createDataFrame([(1, "good words here"), *[(2, f"bad words {i}") for i in range(40)]], "doc_id long, text string")
    chain = toxicity.train(docs, labels(spark, 3))
    assert toxicity.score(docs, chain).count() == 41


def test_decontamination_indexes_every_text_of_an_item(spark):
    from hodoscope.llm.decontam import contaminated

    rng = np.random.default_rng(4)
    said = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 40)) + "? " + " ".join(f"a{x}" for x in rng.integers(0, 9000, 6)) for _ in range(4)]
    items = spark.createDataFrame([(1, said[0]), (1, said[1]), (1, ""), (1, None), (1, said[0]), (2, said[2])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in enumerate(said)] + [(9, f"{said[0]} and {said[1]}")], "doc_id long, text string")
    found = [(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()]
    assert sorted(found) == [(0, 1), (1, 1), (2, 2), (9, 1)]


def test_language_sample_takes_one_row_of_an_id(spark):
    from hodoscope.llm.langid import held_out, train

    ids = [r.i for r in spark.range(200).withColumnRenamed("id", "i").where(~held_out(F.col("i"))).collect()]
    rows = [(i, f"alpha beta {i}" if i % 2 else f"uno dos {i}", "en" if i % 2 else "es") for i in ids]
    more = rows + [(ids[0], f"zulu {k}", "en") for k in range(500)]
    t = train(spark.createDataFrame(more, "doc_id long, text string, lang string"), rows=50)
    assert t.names == ["en", "es"]


def test_many_license_finds_in_one_text():
    import time

    said, began = "Released under the MIT License. ", time.process_time()
    found = licenses.scan(said * 16_000)
    assert len(found) == 16_000 and [f[2] for f in found] == sorted(f[2] for f in found)
    assert all(a[3] <= b[2] for a, b in zip(found, found[1:]))
    assert time.process_time() - began < 20  # quadratic work took minutes
    few = licenses.scan(said * 7 + "x y z " + said * 3)
    assert len(few) == 10
