"""Every stage of the pipeline on odd tables: nulls, nothing, equal rows, columns named like results."""

import pytest

import corpus_pipeline
from tests.llm.samples import odd_texts

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, measures int, "
          "n_words string, N_Removed string, base_failed string")
LONG = " ".join(f"word{i}" for i in range(80))


def rows():
    texts = [*odd_texts(), LONG, LONG, f"other start of a text here and now {LONG}"]
    out = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "k", 7, "w", "r", "b") for i, t in enumerate(texts)]
    return [*out, out[-1], (None, LONG, "en", None, 1, "k", 7, "w", "r", "b"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_tables(spark, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, SF)
    if name == "packing":
        assert out.count() >= len(rows())
        assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    else:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        given = {(r[0], *r[2:4], *r[5:]) for r in rows()}
        assert all((r[0], *r[2:4], *r[5:]) in given for r in got)
        ids = sorted(str(r[0]) for r in got)
        everything = sorted(str(r[0]) for r in rows())
        if name == "repeated_passages":
            assert ids == everything
            texts = {r["doc_id"]: r["text"] for r in got}
            n = len(odd_texts())
            assert texts[n] == LONG and texts[n + 1] == "" and texts[n + 2] == "other start of a text here and now"
        elif name == "near_duplicates":
            n = len(odd_texts())
            assert set(everything) - set(ids) == {str(n + 1), str(n + 2)} and ids.count("None") == 2
        elif name == "decontamination":
            assert ids == everything
        else:
            assert all(len((r["text"] or "").split()) >= 10 for r in got)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_steps_of_earlier_stages_go(spark, tmp_path):
    """A stage gives back the folders of the one before, unless it still reads them."""
    import os

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, SF)
    held = list(corpus_pipeline._steps)
    path = str(tmp_path / "out")
    first.write.parquet(path)
    local = [p.removeprefix("file:") for p in held]
    assert held and all(os.path.exists(p) for p in local)
    corpus_pipeline.near_duplicates(spark, first, SF)  # its input is read from those folders still
    assert any(os.path.exists(p) for p in local)
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), SF)
    assert not any(os.path.exists(p) for p in local)
