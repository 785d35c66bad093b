"""Results that must stay whole: lists of a key, fingerprints, windows common to all texts."""

from pyspark.sql import functions as F

from timelane.functions.scalars import hash_hex
from timelane.operators import overlap
from timelane.operators.ordered import lists_per_key
from timelane.operators.selection import set_fingerprint

c = F.col


def test_lists_are_whole_or_have_a_reason(spark):
    df = spark.range(50).select((c("id") % 3).alias("k"), (c("id") * 7 % 50).alias("o"), c("id").alias("v"))
    rows = {r.k: r for r in lists_per_key(df.where("k < 2 or v < 12"), "k", "o", c("v"), "vs", most=16).collect()}
    assert rows[0].items == 17 and rows[0].vs is None and rows[0].reason == "too_many"
    assert rows[2].vs == sorted((v for v in range(2, 12, 3)), key=lambda v: v * 7 % 50) and rows[2].reason is None
    assert lists_per_key(df.limit(0), "k", "o", c("v"), "vs").count() == 0


def test_fingerprint_names_the_set(spark):
    refs = [(1, i % 4, i) for i in range(40)]
    make = lambda rows: set_fingerprint(
        spark.createDataFrame(rows, "s int, pair bigint, idx bigint"), "s", "x-").first().fingerprint
    assert make(refs) == make(refs[::-1] + refs[:5]) != make(refs[1:])


def test_hash_hex_keeps_long_values(spark):
    got = spark.createDataFrame([(255,), (2**40,)], "v bigint").select(hash_hex(c("v")).alias("h")).collect()
    assert [r.h for r in got] == ["0x000000ff", "0x10000000000"]


def test_window_in_every_text(spark, monkeypatch):
    common = "the same thirty-nine bytes in every text"
    scan = spark.createDataFrame([(i, f"{i:08d}{common}") for i in range(300)], "a int, text string")
    target = spark.createDataFrame([(i, common + str(i)) for i in range(5)], "b int, text string")
    want = {(a, b): (8, 2) for a in range(300) for b in range(5)}
    for most in (overlap.MOST_HASHES, 0):
        monkeypatch.setattr(overlap, "MOST_HASHES", most)
        rows = overlap.window_hash_search(scan, target, scan_key="a", target_key="b").collect()
        assert {(r.a, r.b): (r.first_offset, r.windows) for r in rows} == want


def test_window_classes_grow_with_the_texts(spark):
    """A window in all texts is one class and a member per text, not a row per pair."""
    common = "the same thirty-nine bytes in every text"
    for n in (50, 100):
        scan = spark.createDataFrame([(i, f"{i:08d}{common}") for i in range(n)], "a int, text string")
        target = spark.createDataFrame([(i, common + str(i)) for i in range(n)], "b int, text string")
        classes, members = overlap.shared_windows(scan, target, scan_key="a", target_key="b")
        rows = classes.collect()
        assert [(bytes(r.window).decode(), r.scans, r.targets, r.first_scan, r.first_target) for r in sorted(rows)] == [
            (w, n, n, 0, 0) for w in sorted((common[:32], common[8:40]))]
        assert members.count() == 2 * n


def test_ranks_over_ranges(spark):
    from timelane.operators.trees import ranked_entries

    rows = [(i, f"n{(i * 7919) % 97}", (i * 31) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "ord int, name string, size int").repartition(7)
    for key, down, value in (("size", True, lambda r: -r[2]), ("name", False, lambda r: (r[1],))):
        got = ranked_entries(df, key, "ord", down).select("ord", "place").collect()
        want = sorted(rows, key=lambda r: (value(r), r[0]))
        assert dict(map(tuple, got)) == {r[0]: i + 1 for i, r in enumerate(want)}
    assert ranked_entries(df.limit(0), "size", "ord").count() == 0


def test_repair_rounds_move_rows_of_wrong_pieces_only(spark, monkeypatch):
    from timelane.operators import fold, gates

    moved = []
    rows_of = fold._rows_of

    def seen(rows, pieces, by):
        out = rows_of(rows, pieces, by)
        moved.append((pieces.count(), out.count(), rows.count()))
        return out

    monkeypatch.setattr(fold, "_rows_of", seen)
    df = spark.createDataFrame([("hot", i, i * 50) for i in range(400)], "series string, ord bigint, ts_ms bigint")
    got = gates.throttle(df, "series", ["ts_ms", "ord"], 170, rows_per_chunk=100)
    assert [r.ord for r in got.orderBy("ord").collect()] == list(range(0, 400, 4))
    first, *repairs = moved
    assert first[1] == first[2] == 400
    assert all(n < first[0] and rows < 400 for n, rows, _ in repairs)
