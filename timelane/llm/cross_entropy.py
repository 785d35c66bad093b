"""Cross-entropy difference of a target and a background bigram model.

Both models have the same order, smoothing and vocabulary: the words that occur LEAST_COUNT times
in all texts, and classes by length for the others. The background is all texts, the target those
that are marked. Counts cover every text, and each text moves once, as numbers. Texts are cut into
chunks; a chunk sends each bucket the pairs and symbols that lie there with its own counts of them; a
bucket adds up the counts of all chunks and answers each of them in the order in which it asked. Then
a chunk has all that its texts' losses need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.llm.bits import bit_field, bits_for
from timelane.llm.store import gathered, release, stored
from timelane.llm.words import SPACED_LOWER, mix, word_slices

c = F.col

LEAST_COUNT = 5
LENGTHS = 16
"""Classes of words outside the vocabulary: by their bytes, the last for all longer ones."""
DISCOUNT = 0.75
FIELD_BITS = 27
LISTED = 1 << 16
NUMBERED = 1 << 21
"""Words of the vocabulary that have numbers, the commonest; others go by their hashes."""
CHUNK_WORDS = 1 << 20
CHUNK_TEXTS = 1 << 15
BUCKET_WORDS = 1 << 22
LEAST_BUCKETS = 32
_HELD = 2_000_000
_MOST_COUNTED = 1 << 16
# Ids of symbols: classes by length, numbered words, the start; other words by a hash beyond them.
_START = (1 << 24) - 1
_HASHED = 1 << 62
_TOTALS = -1
_ASKED, _TEXTS, _ANSWER, _FACTS = range(4)
_ROWS = "bucket bigint, chunk bigint, kind tinyint, body binary"


def _texts(records: DataFrame, key: str, text: str, *more) -> DataFrame:
    return records.select(c(f"`{key}`").cast("bigint").alias("k"), c(f"`{text}`").cast("string").alias("t"), *more)


def _summed(parts: list) -> list[np.ndarray]:
    """Add up counts over equal first columns."""
    value, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [value, np.bincount(at, np.concatenate([p[1] for p in parts]), len(value)).astype(np.int64)]


def _combined(make, names):
    """A function for mapInArrow: arrays of ``make(batch)`` added up in the task, then sent on."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for arrays in make(batch):
                parts.append(arrays)
                held += len(arrays[0])
                if held > _HELD:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > _HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in parts[0]], names=names)
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in _summed(parts)], names=names)

    return run


def _word_counts(records: DataFrame, key: str, text: str) -> DataFrame:
    def count(batch):
        for _, _, words in word_slices(batch.column(1), SPACED_LOWER):
            value, n = np.unique(words.hashes().view(np.int64), return_counts=True)
            yield [value, n]

    rows = _texts(records, key, text).mapInArrow(_combined(count, ["word", "n"]), "word bigint, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def shared_vocabulary(records: DataFrame, *, key: str = "mix", text: str = "text", size: int) -> np.ndarray:
    """Hashes of the commonest words of all texts (ties by hash), sorted."""
    return _commonest(_word_counts(records, key, text), size)


def _commonest(counts: DataFrame, size: int) -> np.ndarray:
    return _hashes(counts.orderBy(c("n").desc(), "word").limit(size))


def _hashes(words: DataFrame) -> np.ndarray:
    return np.sort(words.select("word").toArrow().column(0).to_numpy().astype(np.int64))


class _Listed:
    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, self.words)


def _salted(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes.view(np.uint64) + np.uint64(level)).view(np.int64)


def _known(records: DataFrame, key: str, text: str, size: int | None):
    """A test of word hashes for the vocabulary, right for every word of ``records``."""
    if size is not None:
        return _Listed(shared_vocabulary(records, key=key, text=text, size=size)).has
    return _frequent(stored(_word_counts(records, key, text)))


def _frequent(counts: DataFrame):
    """A test of word hashes for those that occur LEAST_COUNT times, right for every word of ``counts``."""
    return _members(*(counts.where(x).select("word") for x in (c("n") >= LEAST_COUNT, c("n") < LEAST_COUNT)))


def _members(inside: DataFrame, outside: DataFrame):
    """A test of hashes (``word``) for those ``inside``, right for every hash of the two tables.

    A bit field has all hashes inside and some others; the next has those others and
    some hashes inside; and so on, until a list holds the few that are left.
    """
    context = inside.sparkSession.sparkContext
    levels = []

    def found_by(field, level: int):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(field.value.has(_salted(batch.column(0).to_numpy(), level))))

        return run

    while (n := inside.count()) > LISTED:
        level = len(levels)
        field = context.broadcast(bit_field(inside, bits_for(n, FIELD_BITS), lambda h, k=level: _salted(h, k)))
        levels.append(field)
        inside, outside = stored(outside.mapInArrow(found_by(field, level), "word bigint")), inside
    levels.append(context.broadcast(_Listed(_hashes(inside))))

    def known(h: np.ndarray) -> np.ndarray:
        found, left = np.zeros(len(h), np.int64), np.arange(len(h))
        for k, level in enumerate(levels):
            own = h[left] if k == len(levels) - 1 else _salted(h[left], k)
            left = left[level.value.has(own)]
            found[left] += 1
        return found % 2 == 1

    return known


def _marked(records: DataFrame, targets: DataFrame, key: str):
    """A test of the keys of ``records`` for those of ``targets``; no text moves for it."""
    own, every = (
        df.select(c(f"`{key}`").cast("bigint").alias("word")).where("word is not null").distinct() for df in (targets, records))
    inside = stored(own)
    return _members(inside, every.join(inside, "word", "left_anti"))


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, byte by byte: first the lowest bytes of a column, as many as its largest needs."""
    head, parts = [len(columns)], []
    for x in columns:
        x = np.ascontiguousarray(x, np.int64)
        width = (int(x.view(np.uint64).max(initial=0)).bit_length() + 7) // 8
        head += [len(x), width]
        parts.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    sizes, at = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n
    columns = []
    for rows, width in sizes:
        room = 4 if width < 4 else 8
        x = np.zeros((rows, room), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows).T
        columns.append(x.reshape(-1).view(np.int32 if room == 4 else np.int64))
        at += rows * width
    return columns


def _apart(ids: np.ndarray) -> list[np.ndarray]:
    """Ids as three columns, so that the few hashes do not widen the numbers."""
    hashed = ids >= _HASHED
    return [hashed, ids[~hashed], ids[hashed]]


def _together(hashed: np.ndarray, numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ids, which = np.empty(len(hashed), np.int64), hashed.astype(bool)
    ids[~which], ids[which] = numbers, hashes
    return ids


def _ids(hashes: np.ndarray, lengths: np.ndarray, numbered: np.ndarray, known) -> np.ndarray:
    """The symbol of each word: its number or hash if it is in the vocabulary, else its class."""
    at = np.searchsorted(numbered, hashes)
    found = np.zeros(len(hashes), bool)
    inside = at < len(numbered)
    found[inside] = numbered[at[inside]] == hashes[inside]
    ids = np.where(found, LENGTHS + at, np.minimum(lengths, LENGTHS) - 1)
    if known is not None:
        rest = np.flatnonzero(~found)
        rest = rest[known(hashes[rest])]
        ids[rest] = hashes[rest] & (_HASHED - 1) | _HASHED
    return ids


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(buckets - 1)).view(np.int64)


def _cells(now: np.ndarray, counts: np.ndarray, start: int, size: int) -> np.ndarray:
    """The pair that each word ends, as one number: ``size`` times the symbol before, and its own."""
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = start
    cells = before.astype(np.int64)
    cells *= size
    cells += now
    return cells


def _places(cells: np.ndarray, bucket: np.ndarray, hot: np.ndarray):
    """Context, symbol and bucket of each pair, and the order of the pairs in which buckets get them.

    A pair lies where its context does, so that one bucket has all kinds of a context; those of hot
    contexts lie where their symbols do, behind the bucket's other pairs.
    """
    of, to = np.divmod(cells, max(len(bucket), 1))
    place = np.where(hot[of], bucket[to], bucket[of])
    return of, to, place, np.argsort(2 * place + hot[of], kind="stable")


def _chunk_rows(chunk: int, held: list, ids_of, hot: np.ndarray, buckets: int):
    """What a chunk asks of each bucket, and its texts as numbers of its symbols."""
    keys = pa.concat_arrays([x[0] for x in held])
    marked, counts, value, length = (np.concatenate([x[i] for x in held]) for i in range(1, 5))
    symbol, at = np.unique(np.append(ids_of(value, length), np.full(min(len(value), 1), _START)), return_inverse=True)
    bucket = _bucket(symbol, buckets)
    order = np.argsort(bucket, kind="stable")
    symbol, bucket = symbol[order], bucket[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at = place[at].astype(np.int32)
    begin = np.cumsum([0, *[len(x[3]) for x in held]])
    now = np.concatenate([at[b:][x[5]] for x, b in zip(held, begin)])
    held.clear()
    is_hot = np.isin(symbol, hot)
    own = np.repeat(marked, counts)
    singles = [np.bincount(x, minlength=len(symbol)) for x in (now, now[own])]
    cells = _cells(now, counts, at[-1] if len(at) else 0, len(symbol))
    cells *= 2
    cells += own
    cells.sort()
    begin = np.flatnonzero(np.diff(cells >> 1, prepend=-1))
    marks = np.append((cells & 1).astype(np.int8), np.int8(0))
    pairs = np.diff(begin, append=len(cells)), np.add.reduceat(marks, begin, dtype=np.int64)
    of, to, lies, order = _places(cells[begin] >> 1, bucket, is_hot)
    of, to, lies, *pairs = (x[order] for x in (of, to, lies, *pairs))
    del cells, marks, order
    rows = []
    limits = np.arange(buckets + 1)
    symbols_at, pairs_at = (np.searchsorted(x, limits).tolist() for x in (bucket, lies))
    for b in np.unique(bucket).tolist():
        some, these = slice(*symbols_at[b : b + 2]), slice(*pairs_at[b : b + 2])
        split = is_hot[of[these]]
        begin = np.flatnonzero(np.diff(of[these][split], prepend=-1))
        rows.append((b, _ASKED, _packed(
            *_apart(symbol[some]), *[x[some] for x in singles],
            np.bincount(of[these][~split] - some.start, minlength=some.stop - some.start),
            np.searchsorted(hot, symbol[of[these][split][begin]]), np.diff(begin, append=split.sum()),
            *_apart(symbol[to[these]]), *[x[these] for x in pairs])))
    # The commonest symbols get the smallest numbers, which take the least room.
    common = np.argsort(-singles[0], kind="stable")
    place[common] = np.arange(len(common))
    texts = _packed(keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), counts,
                    np.flatnonzero(is_hot), np.searchsorted(hot, symbol[is_hot]), common, place[now])
    rows.append((int(_bucket(np.array([chunk]), buckets)[0]), _TEXTS, texts))
    for b, kind, body in rows:
        yield _row(b, chunk, kind, body)


def _row(bucket: int, chunk: int, kind: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket]), pa.array([chunk]), pa.array([kind], pa.int8()), pa.array([body], pa.binary())],
        names=["bucket", "chunk", "kind", "body"])


def _requests(records: DataFrame, marked, ids_of, hot: np.ndarray, buckets: int, key: str, text: str) -> DataFrame:
    def ask(batches):
        chunk = TaskContext.get().partitionId() << 32
        held, words_held, texts_held = [], 0, 0
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK_TEXTS):
                part = whole.slice(i, CHUNK_TEXTS)
                keys = part.column(0)
                own = marked(keys.fill_null(0).to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False)
                for at, to, words in word_slices(part.column(1), SPACED_LOWER):
                    if held and (words_held + len(words.start) > CHUNK_WORDS or texts_held + to - at > CHUNK_TEXTS):
                        yield from _chunk_rows(chunk, held, ids_of, hot, buckets)
                        chunk, held, words_held, texts_held = chunk + 1, [], 0, 0
                    value, first, which = np.unique(words.hashes().view(np.int64), return_index=True, return_inverse=True)
                    length = (words.end - words.start)[first]
                    held.append((keys.slice(at, to - at), own[at:to], words.counts(), value, length, which.astype(np.int32)))
                    words_held, texts_held = words_held + len(words.start), texts_held + to - at
        if held:
            yield from _chunk_rows(chunk, held, ids_of, hot, buckets)

    return _texts(records, key, text).mapInArrow(ask, _ROWS)


def _answers(hot: np.ndarray):
    """A function for the rows of a bucket: the counts of all chunks, for each chunk that asked for them.

    Contexts that lie in more than one bucket, and totals, are rows of their own for the driver.
    """
    def answer(key, group):
        bucket, kind = key[0].as_py(), group.column("kind").to_numpy()
        asked = group.filter(pa.array(kind == _ASKED))
        out = [group.filter(pa.array(kind == _TEXTS)).select(["bucket", "chunk", "kind", "body"])]
        if not asked.num_rows:
            return out[0]
        rows = [_unpacked(b.as_py()) for b in asked.column("body")]
        symbol = [_together(*x[:3]) for x in rows]
        begin = np.cumsum([0, *map(len, symbol)])
        pairs_begin = np.cumsum([0, *[len(x[8]) for x in rows]])
        of = np.concatenate([y for x, s in zip(rows, symbol) for y in (np.repeat(s, x[5]), np.repeat(hot[x[6]], x[7]))])
        symbol, at = np.unique(np.concatenate(symbol), return_inverse=True)
        singles = [np.bincount(at, np.concatenate([x[i] for x in rows]), len(symbol)) for i in (3, 4)]
        to = np.concatenate([_together(*x[8:11]) for x in rows])
        _, first, which = np.unique(_pair_ids(of, to), return_index=True, return_inverse=True)
        pairs = [np.bincount(which, np.concatenate([x[i] for x in rows]), len(first)) for i in (11, 12)]
        context, by = np.unique(of[first], return_inverse=True)
        facts = [np.bincount(by, x, len(context)) for x in (*pairs, *[x > 0 for x in pairs])]
        own = np.isin(symbol, context) & ~np.isin(symbol, hot)
        here = np.searchsorted(context, symbol[own])
        of_symbol = [*singles, *[np.zeros(len(symbol), np.int64) for _ in facts]]
        for x, y in zip(of_symbol[2:], facts):
            x[own] = y[here]
        for i, chunk in enumerate(asked.column("chunk").to_pylist()):
            some, these = at[begin[i] : begin[i + 1]], which[pairs_begin[i] : pairs_begin[i + 1]]
            out.append(_row(bucket, chunk, _ANSWER, _packed(*[x[some] for x in of_symbol], *[x[these] for x in pairs])))
        shared = np.isin(context, hot)
        words = int(((symbol >= LENGTHS) & (symbol != _START)).sum())
        out.append(_row(bucket, -1, _FACTS, _packed(
            np.append(context[shared], _TOTALS), *[np.append(x[shared], y) for x, y in zip(
                facts, (singles[0].sum(), singles[1].sum(), words, 0))])))
        return pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in out])

    return answer


def _pair_ids(of: np.ndarray, to: np.ndarray) -> np.ndarray:
    return mix(of.view(np.uint64) + mix(to.view(np.uint64) ^ np.uint64(_HASHED))).view(np.int64)


def _facts(answers: DataFrame) -> dict[int, list[int]]:
    """What all buckets together know of the hot contexts, and the totals."""
    def rows(batches):
        for batch in batches:
            for body in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _unpacked(body.as_py())], names=["id", *"abcd"])

    found = answers.where(c("kind") == _FACTS).select("body").mapInArrow(
        rows, "id bigint, a bigint, b bigint, c bigint, d bigint").groupBy("id").agg(*[F.sum(x) for x in "abcd"])
    return {r[0]: list(r[1:]) for r in found.collect()}


def losses(pair, single, context, kinds, total: int, width: int) -> np.ndarray:
    """-log p(word | word before) of one model: absolute discounting over a unigram model."""
    p = (single + 1) / (total + width)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = (np.maximum(pair - DISCOUNT, 0) + DISCOUNT * kinds * p) / context
    return -np.log(np.where(context > 0, seen, p))


def cross_entropy_difference(records: DataFrame, targets: DataFrame, *, key: str = "mix",
                             text: str = "text", size: int | None = None) -> DataFrame:
    """Mean losses per word under both models, and their difference, for every row.

    ``records`` are saved mix files or any table with a whole-number key and a text; ``targets``
    holds the keys of the target texts (nulls, repeated and unknown keys do nothing). Rows: the key, ``n_words``, ``target_loss``,
    ``background_loss`` and ``difference`` (target less background: lower is more like the
    target). Texts without words, and nulls, have zeros. Without target texts the target model
    is even over all words. Equal rows are counted and scored each; an empty table gives no rows.
    The vocabulary is the words that occur LEAST_COUNT times, or the ``size`` commonest. The rows of
    ``records`` must come in the same order if a task runs again, as those of a stored table do.
    """
    spark = records.sparkSession
    steps = []
    with gathered(steps):
        counts = stored(_word_counts(records, key, text))
    most = F.least("n", F.lit(_MOST_COUNTED))
    sizes = counts.groupBy(most.alias("n")).agg(F.count("*").alias("words"), F.sum("n").alias("all")).collect()
    total = sum(r["all"] for r in sizes)
    if size is not None:
        numbered, known = _commonest(counts, size), None
        if len(numbered) > NUMBERED:
            numbered, known = numbered[:NUMBERED], _Listed(numbered).has
    else:
        least, words = _MOST_COUNTED + 1, 0
        for r in sorted(sizes, key=lambda r: -r["n"]):
            words += r["words"]
            if r["n"] < LEAST_COUNT or words > NUMBERED:
                break
            least = r["n"]
        numbered = _hashes(counts.where(c("n") >= least))
        known = None if least <= LEAST_COUNT or not any(LEAST_COUNT <= r["n"] < least for r in sizes) else _frequent(counts)
    buckets = max(LEAST_BUCKETS, 1 << (total // BUCKET_WORDS).bit_length())
    heavy = _hashes(counts.where(c("n") > total // buckets))
    at = np.flatnonzero(np.isin(numbered, heavy))
    hot = np.sort(np.concatenate([np.arange(LENGTHS), LENGTHS + at, [_START]]))
    release(steps, records)
    shared = spark.sparkContext.broadcast(numbered)

    def ids_of(hashes, lengths):
        return _ids(hashes, lengths, shared.value, known)

    asked = _requests(records, _marked(records, targets, key), ids_of, hot, buckets, key, text)
    answers = stored(asked.groupBy("bucket").applyInArrow(_answers(hot), _ROWS))
    facts = _facts(answers)
    of_hot = np.array([facts.get(x, [0] * 4) for x in hot.tolist()], np.int64).T
    totals, width = facts.get(_TOTALS, [0] * 4)[:2], facts.get(_TOTALS, [0] * 4)[2] + LENGTHS + 1

    def score(group):
        kind = group.column("kind").to_numpy()
        keys, empty, n, hot_at, hot_number, common, now = _unpacked(group.filter(pa.array(kind == _TEXTS)).column("body")[0].as_py())
        group = group.filter(pa.array(kind == _ANSWER)).sort_by("bucket")
        found = [_unpacked(b.as_py()) for b in group.column("body")]
        bucket = np.repeat(group.column("bucket").to_numpy(), [len(x[0]) for x in found])
        by_symbol, pairs = (
            [np.concatenate([np.empty(0, np.int64), *[x[i] for x in found]]) for i in r] for r in (range(6), range(6, 8)))
        hot_here = np.zeros(len(bucket), bool)
        hot_here[hot_at] = True
        for x, y in zip(by_symbol[2:], of_hot):
            x[hot_at] = y[hot_number]
        start = hot_at[hot_number == len(hot) - 1]
        cells = _cells(common[now], n, start[0] if len(start) else 0, len(bucket))
        by = np.argsort(cells)
        cells = cells[by]
        is_new = np.diff(cells, prepend=-1) > 0
        pair = cells[is_new]
        which = np.empty(len(cells), np.int32)
        which[by] = np.cumsum(is_new, dtype=np.int32) - 1
        del cells, by
        of, to, _, order = _places(pair, bucket, hot_here)
        loss = np.empty((2, len(pair)))
        for i, x in enumerate(pairs):
            count = np.empty_like(x)
            count[order] = x
            loss[i] = losses(count, by_symbol[i][to], by_symbol[2 + i][of], by_symbol[4 + i][of], totals[i], width)
        in_text = np.repeat(np.arange(len(n)), n)
        mean = [np.bincount(in_text, x[which], len(n)) / np.maximum(n, 1) for x in loss[::-1]]
        return pa.table(
            [pa.array(keys, pa.int64(), mask=empty.astype(bool)), pa.array(n, pa.int64()), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])],
            names=[key, "n_words", "target_loss", "background_loss", "difference"])

    return answers.where(c("kind") != _FACTS).groupBy("chunk").applyInArrow(
        score, f"`{key}` bigint, n_words bigint, target_loss double, background_loss double, difference double")
