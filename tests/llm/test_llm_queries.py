"""Registered queries against their SQL, and where there is none against plain versions."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.oracle import _kind, _norm, _sorted, connect
from timelane.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(_norm(v) for v in r) for r in df.select(*names).collect()]
    cur = connect(SF).execute(SQL[name])
    place = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(place) == names
    assert [_kind(df.schema[n].dataType.simpleString()) for n in names] == [
        _kind(str(cur.description[place[n]][1])) for n in names]
    want = [tuple(_norm(r[place[n]]) for n in names) for r in cur.fetchall()]
    assert got and _sorted(got) == _sorted(want)


def test_near_duplicates(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op3_near_duplicates"](spark, SF).collect()}
    assert got == brute.components(texts, 2)


def test_ids_and_packing(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    at, want = 0, {}
    for i in sorted(ids):
        raw = np.array([*ids[i], 0], "<u4")
        want[i] = (at, len(raw), zlib.crc32(raw.tobytes()))
        at += len(raw)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op8_id_files"](spark, SF).collect()}
    assert got == want
    _check_packed(QUERIES["op10_best_fit_packing"](spark, SF).collect(), ids)


def _check_packed(rows, ids):
    have, used = {}, {}
    for r in rows:
        raw = np.array([*ids[r["doc_id"]], 1], "<u4")
        piece = raw[r["start"] : r["start"] + r["length"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(raw), zlib.crc32(piece.tobytes()))
        have.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(have) == set(ids)
    for groups, total in ((have, {i: len(x) + 1 for i, x in ids.items()}), (used, None)):
        for k, parts in groups.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == total[k] if total else at <= 2048
    rooms = sorted(2048 - sum(n for _, n in v) for v in used.values())
    assert rooms == brute.best_fit([r["length"] for r in rows], 2048)


def test_pipeline_stage_by_stage(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in QUERIES["op9_quality_rules"](spark, SF).where("kept").collect()}
    now = {i: t for i, t in texts.items() if i in kept}
    expect = [dict(now)]
    group = brute.components(now, 5)
    now = {i: t for i, t in now.items() if group[i][1] == i}
    expect.append(dict(now))
    left = brute.left_words(now)
    now = {i: t if len(left[i]) == len(brute.spaced(t)) else left[i] for i, t in now.items()}
    expect.append(now)
    hit = brute.hits({i: t if isinstance(t, str) else b" ".join(t).decode() for i, t in now.items()}, items)
    expect.append({i: t for i, t in now.items() if not (hit[i][1] and 20 * hit[i][1] >= hit[i][0])})
    final = None
    for (name, stage), want in zip(corpus_pipeline.STAGES, [*expect, None]):
        out = stage(spark, docs, SF)
        if want is None:
            final = out.collect()
            break
        assert out.columns == docs.columns, name
        docs = out.cache()
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(got) == set(want), name
        for i, t in want.items():
            assert got[i] == t if isinstance(t, str) else brute.spaced(got[i]) == t, (name, i)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _check_packed(final, {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in got.items()})
    rows = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(rows) == len(final)


def test_other_queries(spark):
    for name in ("op2_cross_entropy_difference", "op6_quadratic_discriminant", "op7_tree_model_text"):
        table = "pages" if "text" in name and name.startswith("op7") else "documents"
        df = QUERIES[name](spark, SF)
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    held = QUERIES["op6_quadratic_discriminant"](spark, "/root/testdata/sf0.01").where("held_out").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").selectExpr("avg(int(predicted = quality))").first()[0]
    assert held > 0.95


def test_only_sql_functions_in_the_rules(spark):
    plan = QUERIES["op9_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))


def test_counts_of_every_text(spark, texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == {i: (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in texts.items()}


def test_alignment_of_every_text(spark, texts):
    import hashlib

    from tests.llm.test_alignment import RESULTS, plain

    rows = QUERIES["op11_token_alignment"](spark, SF).collect()
    got = {r["doc_id"]: tuple(r[x] for x in (*RESULTS[:-1], "groups_sha256")) for r in rows}
    want = plain(texts.values())
    assert got == {i: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in zip(texts, want)}


def test_whitening_of_every_vector(spark):
    from tests.llm.test_whitening import plain as whole

    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    centred, n, deviation, values, basis = whole([r["embedding"] for r in table])
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    got = np.zeros((len(table), 16))
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[at[r["vec_id"]]])
        assert abs(r["explained"] * values.sum() / values[r["component"] - 1] - 1) < 1e-9
    want = centred @ basis[:, :16] / np.sqrt(values[:16])
    assert len(rows) == 16 * len(table)
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-8
