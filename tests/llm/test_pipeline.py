import os
import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from glimmer.llm import tables

COLUMNS = list(corpus_pipeline.COLUMNS)


def sample():
    rng = random.Random(1)
    vocabulary = {"xx": [f"{a}{b}{c}ing" for a in "bcdfghlm" for b in "aeiou" for c in "bcdfghlm"], "yy": [f"{a}{b}{c}kov" for a in "rstvzkpn" for b in "aeiou" for c in "rstvzkpn"]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = []
    for i in range(40):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, "\n".join(text(lang, 25) for _ in range(3)), lang if i % 5 else None, f"s{i % 3}", 0))
    # 40: near copy of 0, 41: exact copy of 1, with its lines; 42: no letters; 43: null; 44: empty
    near = rows[0][1].replace("\n", " ").split()
    near[20] = "other"
    rows += [(40, "\n".join([" ".join(near[:37]), " ".join(near[37:])]), "xx", None, 0), (41, rows[1][1], "yy", "s1", 0), (42, "12 34 !!", "xx", "s0", 0), (43, None, "xx", "s0", 0), (44, "", None, "s0", 0), (None, text("xx", 30), "xx", "s2", 0)]
    return rows


def test_stages(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == COLUMNS
        path = spark.conf.get("spark.sql.warehouse.dir") + f"/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    language, lines, near, mixed, packed = kept
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(language) == {None, *range(42)} and all(r["lang"] for r in language)
    assert ids(lines) == ids(language) - {41}  # all lines of the exact copy are repeats
    assert ids(near) == ids(lines) - {40}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    assert ids(mixed) <= ids(near)
    by_doc = {}
    for r in packed:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
    assert set(by_doc) == ids(mixed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    """The registered query itself: it packs the tokens of the documents that the stages give, and leaves one table.

    Where documents are cut depends on the files that they are in, so the tokens of each are compared.
    """
    import __spark_entry__

    shared = tables.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()))
    rows = tokens(got)
    assert len(set(os.listdir(shared)) - before) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert rows and rows == tokens(docs)


def test_run_over_an_empty_table_and_with_clashing_columns(spark, tmp_path):
    """Further columns, named as the stages name theirs, change nothing; repeated equal rows and a very long text go through."""
    docs = spark.createDataFrame(sample() + [sample()[3]] * 2 + [(90, "word " * 20_000 + "ending", "xx", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs.write.parquet(f"{tmp_path}/plain/documents.parquet")
    docs.selectExpr("*", "1 AS kept", "'x' AS lang_pred", "0.5 AS score", "2 AS size", "'y' AS mix_shard", "3 AS part").write.parquet(f"{tmp_path}/more/documents.parquet")
    plain, more = (corpus_pipeline.run(spark, f"{tmp_path}/{d}").groupBy("doc_id").agg({"length": "sum"}).collect() for d in ("plain", "more"))
    assert plain and sorted(map(str, plain)) == sorted(map(str, more))
    assert {90, 3} <= {r["doc_id"] for r in plain}
