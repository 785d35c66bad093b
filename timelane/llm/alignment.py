"""Tokens of two vocabularies over the same texts, aligned group by group.

A long text is cut into byte ranges that know nothing of tokens. A range yields a
fragment: an open prefix (tokens before the first place where a token of both vocabularies
ends), closed groups, and an open suffix. Fragments compose associatively (suffix and next prefix
become one group), so the fragments of a text are reduced as a tree, in whatever tasks they lie.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from timelane.llm.pieces import KEPT_PIECES, piece_encoder
from timelane.llm.store import stored
from timelane.llm.tokens import _SHOWN, encoder

c = F.col
RANGE = 1 << 16
"""Bytes of a range; a text of at most so many is a single fragment."""
FAN = 16
"""Fragments composed in one task at each level of the tree."""
BUNDLE = 1_500_000
"""Tokens of both vocabularies in one stored row of the second pass."""
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
"""Places where both vocabularies begin a token whatever stands around them."""


class Pair:
    """The two vocabularies, with the bytes that their ids stand for."""

    def __init__(self, left: str, right: str):
        self.left, self.right = encoder(left, plain=True, kept=KEPT_PIECES), piece_encoder(right)
        names = self.left.tokenizer.get_vocab()
        self.left_size = max(names.values()) + 1
        self.left_lengths = np.zeros(self.left_size, np.int64)
        for name, i in names.items():
            self.left_lengths[i] = len(name) if set(name) <= _BYTES else len(name.encode())
        self.right_lengths = self.right.vocabulary.byte_lengths()
        self.right_size = len(self.right_lengths)
        self.kind = np.dtype("<u2" if max(self.left_size, self.right_size) <= 1 << 16 else "<u4")
        ids = range(max(self.left_size, self.right_size))
        self.marked = pa.array([f"{i}{mark}" for mark in ",|;" for i in ids])

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text`` (a space in front included) in both; None where the tokens' bytes
        are not the text's.

        Neither vocabulary changes a byte of a text but for characters it takes for a
        space, which are longer than one; so equal lengths are equal bytes.
        """
        a = np.frombuffer(self.left.encode(text), "<u4").astype(self.kind)
        b = np.frombuffer(self.right.encode(text), self.right.kind).astype(self.kind)
        size = len(text.encode())
        same = self.left_lengths[a].sum() == size and self.right_lengths[b].sum() == size
        return (a, b) if same else None

    def without_texts(self) -> Pair:
        """The same, for work on ids only: what was remembered of texts is given back."""
        for side in (self.left, self.right):
            side.first.clear()
            side.later.clear()
        return self

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.left_lengths[a]), np.cumsum(self.right_lengths[b])


_BYTES = frozenset(_SHOWN)


@lru_cache(maxsize=2)
def pair_of(left: str, right: str) -> Pair:
    """One pair a Python worker and files."""
    return Pair(left, right)


def _marks(ends: np.ndarray, size: int) -> np.ndarray:
    """A byte map of where tokens end; place 0 is before the first byte."""
    found = np.zeros(size + 1, bool)
    found[ends] = True
    return found


# Fragments. (pre_a, pre_b, a, b, suf_a, suf_b, first): ids before the first common end, in closed
# groups, and behind the last one; ``first`` is the range of the first common end, None
# without one, when all tokens are in the prefix. Ids are bytes, so that composing joins them.

FRAGMENT = "first int, pre_a binary, pre_b binary, suf_a binary, suf_b binary, ok boolean"


def compose(x: dict, y: dict) -> tuple[dict, dict | None]:
    """The fragment of two neighbours and the group that closes between them, if one does."""
    ok = x["ok"] and y["ok"]
    if x["first"] is None:
        both = {"pre_a": x["pre_a"] + y["pre_a"], "pre_b": x["pre_b"] + y["pre_b"]}
        return {**y, **both, "ok": ok}, None
    open_a, open_b = x["suf_a"] + y["pre_a"], x["suf_b"] + y["pre_b"]
    if y["first"] is None:
        return {**x, "suf_a": open_a, "suf_b": open_b, "ok": ok}, None
    joined = {**x, "suf_a": y["suf_a"], "suf_b": y["suf_b"], "ok": ok}
    return joined, {"first": y["first"], "pre_a": open_a, "pre_b": open_b}


def byte_ranges(text: str, size: int = RANGE) -> list[tuple[int, int, int, str]]:
    """(from, to, begin, slice) of the ranges of ``text``: the tokens that end behind byte ``from``
    and not behind ``to`` are the range's, and are found by encoding ``slice``, whose
    first byte is ``begin``.

    Ranges end at multiples of ``size``, be it inside a token or a character; a slice reaches to the
    next places where both vocabularies begin a token. A run without such a place
    is not divided, since its merges may depend on all of it.
    """
    at = np.fromiter((m.start() for m in _CUT.finditer(text)), np.int64)
    data = text.encode()
    if len(data) > len(text):
        heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        at = heads[at]
    at = np.concatenate([[0], at, [len(data)]])
    bounds = [0]
    for bound in range(size, len(data), size):
        if at[np.searchsorted(at, bound, side="right") - 1] > bounds[-1]:
            bounds.append(bound)
    bounds.append(len(data))
    out = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        begin = int(at[np.searchsorted(at, low, side="right") - 1])
        end = int(at[np.searchsorted(at, high)])
        out.append((low, high, begin, data[begin:end].decode()))
    return out


def fragment(pair: Pair, low: int, high: int, begin: int, text: str, part: int) -> dict:
    """The fragment of one range, with its closed groups ``a`` and ``b``."""
    found = pair.tokens(text)
    if found is None:
        return {"first": None, "ok": False, **dict.fromkeys(("pre_a", "pre_b", "a", "b", "suf_a", "suf_b"), b"")}
    sides, every = [], []
    for ids, ends in zip(found, pair.ends(*found)):
        ends = ends + begin
        own = (ends > low) & (ends <= high)
        sides.append((ids[own], ends[own]))
    (a, ea), (b, eb) = sides
    common = np.intersect1d(ea, eb, assume_unique=True)
    out = {"first": part if len(common) else None, "ok": True}
    for side, (ids, ends) in zip("ab", sides):
        if len(common):
            one, two = (int(np.searchsorted(ends, x, side="right")) for x in (common[0], common[-1]))
        else:
            one = two = len(ids)
        every = (("pre_", slice(0, one)), ("", slice(one, two)), ("suf_", slice(two, None)))
        out |= {f"{name}{side}": ids[cut].tobytes() for name, cut in every}
    return out


# Bundles: the closed groups of many texts in one stored row; ids are compressed.

_RECORDS = "rows array<bigint>, places array<bigint>, n_a array<bigint>, n_b array<bigint>, a binary, b binary"


def _bundle_schema(field) -> StructType:
    keys = StructType([field]).fields[0]
    return StructType([StructField("keys", _array(keys.dataType)), *StructType.fromDDL(_RECORDS).fields])


def _array(kind):
    from pyspark.sql.types import ArrayType

    return ArrayType(kind)


class _Packer:
    """Gathers records (key, row, place, a, b) until they fill a bundle."""

    def __init__(self, schema: pa.Schema, width: int):
        self.schema, self.width, self.rows, self.size = schema, width, [], 0

    def add(self, *record) -> pa.RecordBatch | None:
        self.rows.append(record)
        self.size += (len(record[3]) + len(record[4])) // self.width
        return self.flush() if self.size >= BUNDLE else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        key, row, place, a, b = zip(*self.rows)
        counts = [[len(x) // self.width for x in side] for side in (a, b)]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        values = [list(key), list(row), list(place), *counts, squeeze(b"".join(a)), squeeze(b"".join(b))]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, self.schema)], schema=self.schema)


def _with_id(bundles: DataFrame) -> DataFrame:
    """Stored with an id; as it is written with the row, a repeated task reads the same one."""
    return stored(bundles.withColumn("bundle", F.monotonically_increasing_id()))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _short_bundles(mixes: DataFrame, key: str, text: str, left: str, right: str) -> DataFrame:
    """Texts of one range, each its own whole fragment, encoded where they lie."""
    schema = _bundle_schema(mixes.schema[key])
    arrow = _arrow(schema)

    def encode(batches):
        pair = pair_of(left, right)
        packer = _Packer(arrow, pair.kind.itemsize)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pair.tokens(" " + t) if t else None
                a, b = (x.tobytes() for x in found) if found else (b"", b"")
                if full := packer.add(k, None, 1, a, b):
                    yield full
        if rest := packer.flush():
            yield rest

    return _with_id(mixes.select(key, text).mapInArrow(encode, schema))


def _ranges(mixes: DataFrame, key: str, text: str, size: int) -> DataFrame:
    field = mixes.schema[key]
    numbered = mixes.select(key, text, F.monotonically_increasing_id().alias("row"))
    schema = StructType([field, *StructType.fromDDL(
        "row bigint, part int, low bigint, high bigint, begin bigint, slice string").fields])
    arrow = _arrow(schema)

    def cut(batches):
        for batch in batches:
            for record in batch.to_pylist():
                for part, (low, high, begin, piece) in enumerate(byte_ranges(" " + record[text], size)):
                    values = (record[key], record["row"], part, low, high, begin, piece)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    # stored with its row number, so that fragments of one text find each other after any loss
    return stored(numbered.mapInArrow(cut, schema))


def _fragments(ranges: DataFrame, key: str, left: str, right: str) -> DataFrame:
    schema = StructType([ranges.schema[key], *StructType.fromDDL(
        f"row bigint, part int, {FRAGMENT}, a binary, b binary").fields])
    arrow = _arrow(schema)

    def encode(batches):
        pair = pair_of(left, right)
        for batch in batches:
            for r in batch.to_pylist():
                found = fragment(pair, r["low"], r["high"], r["begin"], r["slice"], r["part"])
                row = {key: r[key], "row": r["row"], "part": r["part"], **found}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    spread = ranges.repartition("row", "part")
    return stored(spread.mapInArrow(encode, schema))


_EDGE = f"row bigint, part int, {FRAGMENT}, kind int"


def _reduce(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Compose the fragments of each text by a tree; the wholes and the groups closed on the way."""
    arrow = _arrow(StructType.fromDDL(_EDGE))

    def level(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole, out = rows[0], []
        for r in rows[1:]:
            whole, group = compose(whole, r)
            if group:
                out.append({**r, **group, "suf_a": b"", "suf_b": b"", "kind": 1})
        out.append({**whole, "row": rows[0]["row"], "part": rows[0]["part"] // FAN, "kind": 0})
        return pa.Table.from_pylist(out, schema=arrow)

    closed = []
    parts = edges.agg(F.max("part")).first()[0]
    while parts:
        up = edges.withColumn("_up", F.floor(c("part") / FAN))
        both = stored(up.groupBy("row", "_up").applyInArrow(level, _EDGE))
        closed.append(both.where("kind = 1"))
        edges, parts = both.where("kind = 0").drop("kind"), parts // FAN
    return edges, closed


def _long_bundles(fragments: DataFrame, key: str, width: int) -> DataFrame:
    """Closed groups of texts of many ranges: those inside ranges and those between them."""
    narrow = ["row", "part", "first", "pre_a", "pre_b", "suf_a", "suf_b", "ok"]
    wholes, closed = _reduce(fragments.select(*narrow))
    keys = fragments.where("part = 0").select(c("row").alias("_row"), key)
    inner = fragments.select("row", (c("part") * 2 + 1).cast("bigint").alias("place"), "a", "b")
    # the first group of a text begins at its start, so the prefix of the whole is closed
    heads = wholes.where("ok").select(c("row"), (c("first") * 2).cast("bigint").alias("place"),
                                      c("pre_a").alias("a"), c("pre_b").alias("b"))
    records = inner.unionByName(heads)
    for groups in closed:
        records = records.unionByName(groups.select(
            "row", (c("first") * 2).cast("bigint").alias("place"),
            c("pre_a").alias("a"), c("pre_b").alias("b")))
    good = wholes.where("ok").select(c("row").alias("_row"))
    # a text whose bytes are not its tokens' keeps one record without tokens
    lossy = wholes.where("not ok").select(
        "row", F.lit(0).cast("bigint").alias("place"), F.lit(b"").alias("a"), F.lit(b"").alias("b"))
    records = records.join(good, c("row") == c("_row"), "left_semi").unionByName(lossy)
    field = fragments.schema[key]
    schema = _bundle_schema(field)
    arrow = _arrow(schema)

    def pack(batches):
        packer = _Packer(arrow, width)
        for batch in batches:
            for r in batch.to_pylist():
                if full := packer.add(r["_key"], r["row"], r["place"], r["a"], r["b"]):
                    yield full
        if rest := packer.flush():
            yield rest

    named = records.join(keys, c("row") == c("_row")).select(c(key).alias("_key"), "row", "place", "a", "b")
    return _with_id(named.mapInArrow(pack, schema))


class _Bundle:
    """One bundle's tokens as one run of bytes: every record begins and ends at a common end.

    Between two neighbouring ends lie the bytes of just one token of each kind, and a pair
    overlaps in one such stretch only, so there are as many links as different ends.
    """

    def __init__(self, pair: Pair, row: dict):
        expand = zstandard.ZstdDecompressor().decompress
        self.a, self.b = (np.frombuffer(expand(row[x]), pair.kind) for x in "ab")
        ea, eb = pair.ends(self.a, self.b)
        size = int(ea[-1]) if len(ea) else 0
        in_a, in_b = _marks(ea, size), _marks(eb, size)
        self.last_a, self.last_b = in_b[ea], in_a[eb]  # whether a token closes a group
        self.n_a, self.n_b = (np.array(row[x], np.int64) for x in ("n_a", "n_b"))
        self.ends = np.flatnonzero(in_a | in_b)
        self.common = np.flatnonzero(in_a & in_b)
        la, lb = (np.cumsum(m[self.ends]) - m[self.ends] for m in (in_a, in_b))
        self.pairs = self.a[la].astype(np.int64) * pair.right_size + self.b[lb]
        self.limits = np.r_[0, ea][np.r_[0, np.cumsum(self.n_a)]]  # bytes before each record

    def per_record(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(values)]
        at = np.searchsorted(ends, self.limits, side="right")
        return run[at[1:]] - run[at[:-1]]

    def texts(self, pair: Pair) -> list[str]:
        """Groups of each record as ``a1,a2|b1;a3|b2,b3``."""
        width = len(pair.marked) // 3
        ga, gb = (np.cumsum(x) - x for x in (self.last_a, self.last_b))  # group of each token
        a_upto = np.r_[0, np.flatnonzero(self.last_a) + 1]  # left tokens before each group
        b_upto = np.r_[0, np.flatnonzero(self.last_b) + 1]
        codes = np.empty(len(self.a) + len(self.b), np.int32)
        codes[np.arange(len(self.a)) + b_upto[ga]] = self.a + self.last_a.astype(np.int32) * width
        codes[np.arange(len(self.b)) + a_upto[gb + 1]] = self.b + self.last_b.astype(np.int32) * (2 * width)
        parts = pair.marked.take(pa.array(codes))  # strings taken one after another lie joined
        _, where, data = parts.buffers()
        joined = data.to_pybytes() if data is not None else b""
        where = np.frombuffer(where, np.int32)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
        at = where[np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        return [joined[x : y - 1].decode() if y > x else "" for x, y in zip(at[:-1], at[1:])]


def _pair_counts(bundles: DataFrame, left: str, right: str) -> DataFrame:
    """How often each bundle links each pair of ids."""
    schema = "bundle bigint, pair bigint, n bigint"
    arrow = _arrow(StructType.fromDDL(schema))

    def count(batches):
        pair = pair_of(left, right).without_texts()
        for batch in batches:
            for row in batch.to_pylist():
                found, n = np.unique(_Bundle(pair, row).pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row["bundle"])), pa.array(found), pa.array(n)], schema=arrow)

    return stored(bundles.mapInArrow(count, schema))


RESULTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _resolved(bundles: DataFrame, known: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Per record its groups and sums, from the corpus-wide counts of its bundle's pairs."""
    field = bundles.schema["keys"].dataType.elementType
    schema = StructType([StructField(key, field), *StructType.fromDDL(f"row bigint, place bigint, {RESULTS}").fields])
    arrow = _arrow(schema)

    def resolve(one: pa.Table, answers: pa.Table) -> pa.Table:
        pair = pair_of(left, right).without_texts()
        out = []
        order = np.argsort(answers["pair"].to_numpy())
        pairs, counts, best = (answers[x].to_numpy()[order] for x in ("pair", "total", "best"))
        for row in one.to_pylist():
            held = _Bundle(pair, row)
            at = np.searchsorted(pairs, held.pairs)
            ones = np.ones(len(held.pairs), np.int64)
            columns = [
                row["keys"], row["rows"], row["places"], row["n_a"], row["n_b"],
                held.per_record(np.ones(len(held.common), np.int64), held.common),
                held.per_record(ones, held.ends),
                held.per_record(best[at].astype(np.int64), held.ends) if len(at) else np.zeros(len(held.n_a), np.int64),
                held.per_record(counts[at], held.ends) if len(at) else np.zeros(len(held.n_a), np.int64),
                held.texts(pair),
            ]
            out.append(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    mine = known.select(c("bundle").alias("_of"), "pair", "total", "best")
    return bundles.groupBy("bundle").cogroup(mine.groupBy("_of")).applyInArrow(resolve, schema)


def align_tokens(
    mixes: DataFrame, left: str, right: str, key: str = "mix", text: str = "text", size: int = RANGE
) -> DataFrame:
    """Tokens of the saved text of each mix by two vocabularies, aligned, with their link counts.

    ``mixes``: ``key`` and the whole ``text`` of a mix file (:func:`write_mix_files` gives such
    rows); any table of texts will do. ``left`` is the path of a byte-level ``.json`` file and
    ``right`` of a sentencepiece ``.model`` file, on every executor; both encode a space and
    the text, special strings as plain text. One row per row of ``mixes``: ``key``; ``n_a``,
    ``n_b`` tokens; ``n_groups`` between places where tokens of both end; ``n_links`` pairs of
    tokens whose bytes overlap; ``count_sum``, the sum over links of how many links of all texts
    hold their id pair; ``n_best`` links whose pair has the highest such count of its right
    id, ties included; ``groups`` as ``a1,a2|b1;a3|b2,b3``.

    A null or empty text, and one that a vocabulary does not keep byte for byte, has zeros and an
    empty ``groups``. Rows with equal keys and null keys stay apart; other columns are
    not read, whatever their names; an empty table gives none.

    Texts above ``size`` bytes are cut into ranges that spread over tasks (a run without any
    place to cut, such as one word, stays whole). Counts are summed per bundle of about
    one and a half million tokens, met with the corpus's once per bundle and pair, so neither a common pair
    nor a long text makes a large task; the best count of each right id is broadcast, at most one
    row per id of the vocabulary. ``groups`` of one text is one value, as the text is.
    """
    taken = {"row", "place", "bundle", *(x.split()[0] for x in RESULTS.split(", "))}
    if key in taken:
        raise ValueError(f"the key may not be named {key}")
    width = pair_of(left, right).kind.itemsize
    n_right = pair_of(left, right).right_size
    is_long = F.coalesce(F.octet_length(text) > size - 1, F.lit(False))
    short = _short_bundles(mixes.where(~is_long), key, text, left, right)
    fragments = _fragments(_ranges(mixes.where(is_long), key, text, size), key, left, right)
    long = _long_bundles(fragments, key, width)
    counted = [_pair_counts(b, left, right) for b in (short, long)]
    totals = stored(counted[0].unionByName(counted[1]).groupBy(c("pair").alias("_pair")).agg(F.sum("n").alias("total")))
    highest = totals.groupBy((c("_pair") % n_right).alias("_right")).agg(F.max("total").alias("_high"))
    judged = totals.join(F.broadcast(highest), c("_pair") % n_right == c("_right")).select(
        "_pair", "total", (c("total") == c("_high")).alias("best"))
    sums = [x.split()[0] for x in RESULTS.split(", ")]
    done = []
    for bundles, pairs in zip((short, long), counted):
        known = pairs.join(judged, c("pair") == c("_pair"))
        done.append(_resolved(bundles, known, key, left, right))
    piece = F.struct("place", "groups")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("n_groups") > 0, piece))),
                                      lambda p: p["groups"]), ";")
    whole = done[1].groupBy("row").agg(
        F.first(key).alias(key), *[F.sum(n).alias(n) for n in sums[:-1]], joined.alias("groups"))
    return done[0].select(key, *sums).unionByName(whole.select(key, *sums))
