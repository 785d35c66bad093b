import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.samples import mixes, none, odd_texts
from timelane.llm.id_coder import BLOCK, decode_frame, encode_frame
from timelane.llm.id_files import read_id_files, write_id_files
from timelane.llm.revisits import canonical_url, resolve_revisits
from timelane.llm.store import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7])
@pytest.mark.parametrize("most", [1, 2, 300, 50_257])
def test_frames_come_back(n, most):
    rng = np.random.default_rng(n + most)
    ids = np.minimum(rng.geometric(0.01, n) - 1, most - 1) if most == 300 else rng.integers(0, most, n)
    ids = ids.astype("<u4")
    keys, lengths = np.array([-5, 2**62]), np.array([n // 3, n - n // 3])
    k, size, x = decode_frame(encode_frame(keys, lengths, ids))
    assert (k == keys).all() and (size == lengths).all() and (x == ids).all()


def test_frames_are_small_and_checked():
    text = np.tile(np.arange(40), 500).astype("<u4")
    frame = encode_frame(np.array([1]), np.array([len(text)]), text)
    assert len(frame) < len(text) / 4  # the ids that come back are foreseen
    broken = bytearray(frame)
    broken[-20] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        decode_frame(bytes(broken))
    broken = bytearray(frame)
    broken[30] ^= 4
    with pytest.raises(ValueError, match="damaged"):
        decode_frame(bytes(broken))
    with pytest.raises(ValueError, match="not a frame"):
        decode_frame(b"PAR1" + frame[4:])


def test_id_files_of_mixes(spark):
    texts = [*odd_texts(), "one", "one"]
    path = scratch_path(spark)
    write_id_files(mixes(spark, texts).orderBy("text"), path, PATH)
    tok, at = Tokenizer.from_file(PATH), 0
    for r in read_id_files(spark, path).orderBy("mix").collect():
        want = tok.encode(texts[r["mix"]] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["length"]) == (at, len(want))
        assert r["ids"] == np.array(want, "<u4").tobytes()
        at += len(want)


def test_id_files_of_odd_tables(spark):
    path = scratch_path(spark)
    write_id_files(none(spark), path, PATH)
    assert read_id_files(spark, path).count() == 0
    path = scratch_path(spark)
    write_id_files(spark.createDataFrame([(None, "a"), (2, None), (2, None)], "mix bigint, text string"), path, PATH)
    rows = read_id_files(spark, path).orderBy("start").collect()
    assert [(r["mix"], r["start"], r["length"]) for r in rows] == [(None, 0, 2), (2, 2, 1), (2, 3, 1)]


def test_canonical_url(spark):
    urls = {
        "http://WWW.Ex.com:80/A/?b=2&utm_source=x&a=1#f": "ex.com/A?a=1&b=2", "https://ex.com": "ex.com",
        "https://ex.com/?ref=1": "ex.com", " ex.com/a/b// ": "ex.com/a/b", "http://ex.com:8080/a?": "ex.com:8080/a",
        "": None, None: None,
    }
    df = spark.createDataFrame([(u, v) for u, v in urls.items()], "u string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", canonical_url(df["u"])).collect())


CAPTURES = "record_id bigint, url string, time bigint, revisit boolean, etag string, last_modified string, headers map<string,string>, status string"


def test_revisits(spark):
    h = {"Content-Type": "a", "Date": "1"}
    rows = [
        (1, "http://x.com/a", 10, False, "e1", "d1", h, "s"), (2, "http://x.com/a", 20, None, "e2", "d2", h, "s"),
        (3, "https://www.x.com/a/", 15, True, "e1", "d9", {"date": "2", "content-type": "b"}, None),
        (4, "http://x.com/a", 25, True, "e1", "d1", h, None), (5, "http://x.com/a", 26, True, None, "d2", None, None),
        (6, "http://x.com/a", 27, True, None, "d1", h, None), (7, "http://x.com/a", 28, True, None, None, h, None),
        (8, "http://x.com/a", 10, True, "e1", None, h, None), (9, "http://x.com/a", 9, True, "e1", None, h, None),
        (10, None, 30, True, "e1", None, h, None), (11, "http://x.com/a", None, True, "e1", None, h, None),
        (12, "http://x.com/b", 30, True, "e1", None, h, None), (4, "http://x.com/a", 25, True, "e1", "d1", h, None),
    ]
    out = resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()
    got = sorted((r["record_id"], r["target_id"], r["status"]) for r in out if r["target_id"])
    assert got == [(3, 1, "resolved"), (4, 2, "etag_differs"), (4, 2, "etag_differs"), (5, 2, "resolved"),
                   (6, 2, "date_differs"), (7, 2, "no_validator"), (8, 1, "resolved")]
    rest = {r["record_id"]: r["status"] for r in out if not r["target_id"]}
    assert rest == {9: "no_response", 10: "no_url", 11: "no_time", 12: "no_response"}
    headers = {r["record_id"]: r["headers"] for r in out}
    assert headers[3] == {"content-type": "a", "date": "2"} and headers[5] == {"content-type": "a", "date": "1"}
    assert headers[4] is None
    assert resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_one_url_with_most_captures(spark):
    rows = [(i, "http://hot.com/", i // 3, i % 7 != 0, "e", None, {}, "s") for i in range(3000)]
    got = {r["record_id"]: r["target_id"] for r in resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert got == {i: i - i % 7 for i in range(3000) if i % 7}


def test_weak_tags_and_shared_ids(spark):
    """Tags are compared weakly, and an id under two URLs gives each its own headers."""
    rows = [
        (1, "http://x.com/a", 10, False, 'W/"e"', None, {"k": "a"}, "s"), (1, "http://x.com/b", 5, False, '"f"', None, {"k": "b"}, "s"),
        (2, "http://x.com/a", 20, True, '"e"', None, {}, None), (3, "http://x.com/b", 20, True, 'W/"f"', None, {}, None),
        (4, "http://x.com/b", 21, True, 'W/"e"', None, {}, None),
    ]
    out = {r["record_id"]: (r["status"], r["headers"]) for r in resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert out == {2: ("resolved", {"k": "a"}), 3: ("resolved", {"k": "b"}), 4: ("etag_differs", None)}
