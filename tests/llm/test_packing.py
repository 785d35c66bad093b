import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.samples import mixes, none, odd_texts
from timelane.llm.packing import OpenWindows, best_fit_windows, cut_windows, plan_best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tightest_window():
    tree = OpenWindows(64)
    assert tree.tightest(1) is None
    for room in (5, 9, 64):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (1, 5, 6, 9, 10, 64)] == [5, 5, 9, 9, 64, 64]
    tree.add(9, -1)
    assert tree.tightest(6) == 64


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(150):
        window = rng.choice([8, 64, 2048])
        sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 150))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        windows, ranks = {}, set()
        for length, first, n, base, offset in plan_best_fit(counts, window).tolist():
            for i in range(n):
                ranks.add((length, first + i))
                windows.setdefault(base + i, []).append((offset, length))
        assert ranks == {(s, i) for s, n in counts.items() for i in range(n)}
        rooms = []
        for held in windows.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            rooms.append(window - at)
        assert sorted(rooms) == brute.best_fit(sizes, window)


def test_pack_mix_files(spark):
    texts = [*odd_texts(), "one", "one"]
    pieces = cut_windows(mixes(spark, texts), PATH)
    rows = best_fit_windows(pieces).collect()
    tok = Tokenizer.from_file(PATH)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    got = {}
    for r in rows:
        assert r["total"] == len(want[r["mix"]]) and 4 * r["length"] == len(r["ids"])
        got.setdefault(r["mix"], {})[r["start"]] = r["ids"]
    for i, ids in want.items():
        raw = b"".join(got[i][s] for s in sorted(got[i]))
        assert raw == np.array(ids, "<u4").tobytes()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(used) == list(range(len(used)))
    rooms = []
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        rooms.append(2048 - at)
    assert sorted(rooms) == brute.best_fit([r["length"] for r in rows], 2048)


def test_odd_tables(spark):
    assert best_fit_windows(cut_windows(none(spark), PATH)).count() == 0
    same = spark.createDataFrame([(None, "a"), (None, "a"), (3, None), (3, None)], "mix bigint, text string")
    rows = best_fit_windows(cut_windows(same, PATH)).collect()
    assert sorted((r["mix"] is None, r["length"]) for r in rows) == [(False, 1), (False, 1), (True, 2), (True, 2)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    clash = spark.createDataFrame([(1, 0, 5, "x", 9)], "mix bigint, start bigint, length bigint, offset string, Sequence_ID int")
    assert best_fit_windows(clash).first().asDict() == {"mix": 1, "start": 0, "length": 5, "sequence_id": 0, "offset": 0}
    with pytest.raises(ValueError):
        best_fit_windows(spark.createDataFrame([(1, 0, 4096)], "mix bigint, start bigint, length bigint"))
