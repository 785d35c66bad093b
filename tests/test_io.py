import json

from pyspark.sql import functions as F

from timelane.sources import state as S
from timelane.sources.pairs import named_pairs, write_pairs
from timelane.sources.ranges import RangeSource
from timelane.operators import sessions as Z

c = F.col


def test_byte_ranges_cover_every_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {"a.bin": bytes(range(256)) * 4, "sub/b.BIN": b"xyz", "skip.txt": b"no", "empty.bin": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.dataSource.register(RangeSource)
    df = (spark.read.format("byteranges").option("path", str(tmp_path)).option("suffix", ".bin")
          .option("rangeBytes", 300).load())
    assert df.rdd.getNumPartitions() == 5
    parts = df.orderBy("file", "start").collect()
    whole = {}
    for r in parts:
        assert r.length == len(r.content) <= 300
        whole[r.file] = whole.get(r.file, b"") + bytes(r.content)
    assert {k[len(str(tmp_path)) + 1:]: v for k, v in whole.items()} == {
        "a.bin": files["a.bin"], "sub/b.BIN": b"xyz"}


def good_mix(**changes):
    mix = {"format": "awc-mix", "version": 2, "awc": {"name": "x.awc", "size": 5, "streamCount": 4,
           "sampleRate": 44100}, "state": {"m": [1, 0], "g": [100, 50], "p": [0, -20], "M": 90},
           "savedAt": "2024-01-01", "appVersion": "9", "other": {"ignored": True}}
    mix.update(changes)
    return json.dumps({k: v for k, v in mix.items() if v is not ...})


def test_mix_file_errors(spark, tmp_path):
    cases = {
        "ok": good_mix(), "json": "{", "root": "[]", "null": "null", "magic": good_mix(format="x"),
        "v1": good_mix(version=1), "v99": good_mix(version=99), "text": good_mix(version="2"),
        "meta": good_mix(awc={}), "nometa": good_mix(awc=...), "state": good_mix(state=...),
        "half": good_mix(state={"m": [], "g": [], "p": []}), "part": good_mix(awc={"name": "n"}),
        "bare": good_mix(savedAt=3, appVersion=...),
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.mix").write_text(text)
    rows = {r.file.split("/")[-1][:-4]: r for r in S.read_mix_files(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in rows.items()} == {
        "ok": None, "json": "invalid_json", "root": "not_object", "null": "not_object",
        "magic": "format", "v1": "version_1", "v99": "version", "text": "version", "meta": "meta",
        "nometa": "meta", "state": "state", "half": "state", "part": None, "bare": None}
    ok = rows["ok"]
    assert (ok.name, ok.size, ok.stream_count, ok.sample_rate, ok.saved_at, ok.app_version) == (
        "x.awc", 5, 4, 44100, "2024-01-01", "9")
    assert (ok.state.m, ok.state.g, ok.state.p, ok.state.master) == ([1, 0], [100.0, 50.0], [0.0, -20.0], 90.0)
    assert (rows["part"].sample_rate, rows["part"].stream_count) == (48000, 0)
    assert (rows["bare"].saved_at, rows["bare"].app_version) == ("", "unknown")


def test_mix_files_round_trip(spark, tmp_path):
    row = spark.range(3).select(
        S.mix_file_json(F.lit('q"uote.awc'), c("id"), F.lit(2), F.lit(48000),
                        S.state_json(F.array(F.lit(1)), F.array(c("id")), F.array(F.lit(-3)), F.lit(99.6)),
                        F.lit("now")).alias("value"))
    S.write_mix_files(row, str(tmp_path / "out"))
    back = S.read_mix_files(spark, str(tmp_path / "out"))
    got = sorted((r.error, r.name, r.size, r.state.g, r.state.master) for r in back.collect())
    assert got == [(None, 'q"uote.awc', i, [float(i)], 100.0) for i in range(3)]
    S.write_mix_files(row.repartition(1), str(tmp_path / "one"))
    assert S.read_mix_files(spark, str(tmp_path / "one")).where("error is null").count() == 3
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "a.json").write_text(row.first().value.replace(",", ",\n"))
    whole = S.read_mix_files(spark, str(tmp_path / "pretty"), wholetext=True).collect()
    assert [(r.error, r.size) for r in whole] == [(None, 0)]


def test_json_must_be_one_value(spark):
    texts = ['{"a":1}', ' {"a":1} ', "[1,2]", "7", '"x"', '{"a":1} trailing', '{"a":1}{"b":2}', "1,2", '1],[2', "1,\"y\":2", "",
             "{oops", None, '{"a":1},{"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good = df.where(S.strict_json(c("t")).isNotNull()).select("i").orderBy("i").collect()
    assert [r.i for r in good] == [0, 1, 2, 3, 4]


def test_compact_state_round_trip(spark):
    kfs = "array(named_struct('time', 1.254D, 'gain', 0.5D, 'easing', 'hold'))"
    df = spark.range(1).select(
        S.write_compact_state(S.state_json(
            F.array(F.lit(1), F.lit(0)), F.array(F.lit(99.5), F.lit(20)), F.array(F.lit(-0.5), F.lit(3)),
            F.lit(100), F.expr(f"array({kfs}, cast(array() as array<struct<time:double,gain:double,easing:string>>))"),
        )).alias("p"))
    text = df.first().p
    assert "=" not in text
    s = df.select(S.read_compact_state(F.concat(F.lit("#a=1&s="), c("p"))).alias("s")).first().s
    assert (s.m, s.g, s.p, s.master) == ([1, 0], [100.0, 20.0], [0.0, 3.0], 100.0)
    assert [(k.time, k.gain, k.easing) for k in s.automation[0]] == [(1.25, 0.5, "hold")]
    assert s.automation[1] is None and not s.legacy_dropped and not s.legacy_v1


def test_write_pairs(spark, tmp_path):
    rows = [(1, f, 0.5, -0.5) for f in range(50)] + [(12, 0, 2.0, 0.0)]
    stereo = spark.createDataFrame(rows, "pair bigint, frame bigint, left_value double, right_value double")
    labels = spark.createDataFrame([(1, "1 LEFT+RIGHT")], "pair bigint, label string")
    out = str(tmp_path / "stems")
    write_pairs(named_pairs(stereo, labels), out)
    back = spark.read.parquet(out)
    counts = {r["name"]: r["count"] for r in back.groupBy("name").count().collect()}
    assert counts == {"pair_01_1_left+right": 50, "pair_12_-": 1}
    assert {(r.left_pcm, r.right_pcm) for r in back.where("name like 'pair_01%'").collect()} == {(16383, -16384)}


def test_prune_examples(spark):
    rows = [("o", f"s{i}", t) for i, t in enumerate([3, 9, 9, 1, 5])]
    df = spark.createDataFrame(rows, "owner string, id string, created bigint")
    left = lambda n: sorted(r.id for r in Z.prune_ids(df, "owner", "id", "created", "id", n).collect())
    assert left(2) == ["s0", "s3", "s4"]
    assert left(0) == left(-1) == ["s0", "s1", "s2", "s3", "s4"]
    assert left(9) == []
    assert [r.id for r in Z.recent_sessions(df, "created", "id", 3).collect()] == ["s1", "s2", "s4"]


def test_settings(spark):
    texts = ['{"accent":"cyan","reduceMotion":true,"autoplayOnLoad":1,"defaultMasterPct":151}', "oops",
             '{"defaultMasterPct":0,"accent":"CYAN"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r.s) for r in df.select(S.settings_with_defaults(c("t")).alias("s")).collect()]
    assert got == [("cyan", True, False, 100.0), ("tangerine", False, False, 100.0), ("tangerine", False, False, 0.0)]
