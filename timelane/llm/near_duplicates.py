"""Near duplicates by a chosen-path set similarity join.

A text is the set of its shingles, with SIGNATURE minwise tokens. A tree branches a node by
one or two of these coordinates, chosen by a hash of the node, on average 1 / similarity of
them; a text goes to the child that its token names. Two texts of the wanted similarity meet
in a child with an expectation of one, others with less, so nodes shrink to those that are alike.
Small nodes are compared exhaustively, and independent trees are repeated up to the target
recall.

Groups of many near copies stay together at any depth. In nodes that are not small each text is
compared with some leaders first. After that only texts of different components matter: a node
whose texts are linked already is finished, one of bounded size is compared exhaustively in one
task, and a larger one branches again. Each branch may part a pair and the trees share their
coordinates, so texts of nodes that branched are searched again with new coordinates, as often as
the depth they reached asks for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timelane.llm.bits import bit_field, bits_for
from timelane.llm.components import components
from timelane.llm.store import small_ids, stored
from timelane.llm.tokens import forget_texts
from timelane.llm.words import SPACED_LOWER, mix, shingle_sums, window_starts, word_slices

c = F.col

SIMILARITY = (80, 100)
SIGNATURE = 64
RECALL = 0.9999
FIRST_DEPTH = 3
DEEPEST = 12
TINY = 16
"""Nodes of up to this many texts give pairs; equal pairs of different trees are compared once."""
SMALL = 512
SMALL_SHINGLES = 1 << 20
"""Other nodes up to this size are compared in one task, which holds their sets (8 MB)."""
LEADERS = 6
FIRST_TREES = 2
"""Trees that are opened before the others."""
FIELD_BITS = 27
_SIGN = np.random.default_rng(5).integers(0, 1 << 31, (2, SIGNATURE), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ALONE = np.uint64(0x5851F42D4C957F2D)


def _parted(agreeing: float, similarity: float, depth: int) -> float:
    """How likely one tree for ``similarity`` parts a pair with this share of equal coordinates."""
    two, miss = 1 / similarity - 1, 0.0
    for _ in range(depth):
        one = 1 - agreeing + agreeing * miss
        miss = (1 - two) * one + two * one * one
    return miss


def trees_for(recall: float, similarity: float, depth: int = FIRST_DEPTH + 1) -> int:
    """Trees after which a pair of just this similarity has met at ``depth`` in one of them, if
    each had coordinates of its own."""
    return math.ceil(math.log(1 - recall) / math.log(_parted(similarity, similarity, depth)))


def missed(similarity: float, trees: int, depth: int) -> float:
    """How likely a pair of just this similarity meets at ``depth`` in none of ``trees`` trees that
    share SIGNATURE coordinates."""
    return sum(
        math.comb(SIGNATURE, k) * similarity**k * (1 - similarity) ** (SIGNATURE - k)
        * _parted(k / SIGNATURE, similarity, depth) ** trees
        for k in range(SIGNATURE + 1)
    )


def shared_trees_for(recall: float, similarity: float) -> int:
    """As trees_for, for trees that share their coordinates, at the depth where nodes are first compared."""
    trees = trees_for(recall, similarity)
    while missed(similarity, trees, FIRST_DEPTH) > 1 - recall:
        trees += 1
    return trees


def searches_for(recall: float, similarity: float, trees: int, depth: int) -> int:
    """Searches with coordinates of their own after which a pair has met at ``depth``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed(similarity, trees, depth)) - 1e-9))


def _sets(words, shingle: int):
    """Sorted distinct shingle hashes of all texts of a slice, and the offsets of each."""
    counts = words.counts()
    h = words.hashes()
    sums = shingle_sums(h)
    start, text = window_starts(words, shingle)
    value = mix(sums(start, shingle))
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        alone = np.concatenate([mix(sums(words.first[short[i : i + 1]], int(counts[short[i]])) ^ _ALONE) for i in range(len(short))])
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        value = np.concatenate([value, alone])[order]
        text = np.concatenate([text, short])[order]
    bound = np.searchsorted(text, np.arange(len(counts) + 1))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def minwise_signatures(records: DataFrame, *, key: str = "mix", text: str = "text", shingle: int = 2) -> DataFrame:
    """Per row: the key, ``n_shingles``, a 128-bit name of the set (``set_a``, ``set_b``) and ``sign``.

    A text of fewer words than a shingle is one shingle; a text without words, or null, has
    an empty set with a null signature.
    """
    def sign(batches):
        forget_texts()
        for batch in batches:
            for at, to, words in word_slices(batch.column(1), SPACED_LOWER):
                value, bound = _sets(words, shingle)
                n = np.diff(bound)
                full = np.flatnonzero(n)
                name = np.zeros((2, len(n)), np.uint64)
                mins = np.zeros((len(n), SIGNATURE), np.uint32)
                if len(full):
                    begin = bound[:-1][full]
                    for lane, salt in enumerate((np.uint64(0), _ALONE)):
                        name[lane, full] = np.add.reduceat(mix(value ^ salt), begin)
                    low = (value >> np.uint64(32)).astype(np.uint32)
                    for j in range(SIGNATURE):
                        mins[full, j] = np.minimum.reduceat(low * _SIGN[0, j] + _SIGN[1, j], begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at), pa.array(n.astype(np.int64)),
                        pa.array(name[0].view(np.int64)), pa.array(name[1].view(np.int64)),
                        pa.array([m.tobytes() if k else None for m, k in zip(mins, n)], pa.binary()),
                    ],
                    names=[key, "n_shingles", "set_a", "set_b", "sign"],
                )

    return records.select(c(f"`{key}`").cast("bigint"), c(f"`{text}`").cast("string")).mapInArrow(
        sign, f"`{key}` bigint, n_shingles bigint, set_a bigint, set_b bigint, sign binary"
    )


def _children(node: np.ndarray, row: np.ndarray, sign: np.ndarray, similarity: float):
    """One level of a tree: nodes and rows of all children."""
    h = mix(node ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    first = (h % np.uint64(SIGNATURE)).astype(np.int64)
    step = ((h >> np.uint64(16)) % np.uint64(SIGNATURE - 1)).astype(np.int64)
    two = (h >> np.uint64(40)).astype(np.float64) < (1 / similarity - 1) * float(1 << 24)
    at = np.concatenate([first, (first[two] + 1 + step[two]) % SIGNATURE])
    of = np.concatenate([node, node[two]])
    row = np.concatenate([row, row[two]])
    token = sign[row, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
    return mix(of ^ mix(token)), row


def _branch(df: DataFrame, levels: int, similarity: float, trees: tuple[int, int] | None) -> DataFrame:
    """Rows (node, text, shingles) some levels below; from the roots of the trees numbered so, or
    from ``node``."""
    def down(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text, shingles = batch.column("text").to_numpy(), batch.column("shingles").to_numpy()
            sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            row = np.arange(len(text))
            if trees is None:
                node = batch.column("node").to_numpy().view(np.uint64)
            else:
                node = mix(np.repeat(np.arange(*trees, dtype=np.uint64), len(text)))
                row = np.tile(row, trees[1] - trees[0])
            for _ in range(levels):
                node, row = _children(node, row, sign, similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array(text[row]), pa.array(shingles[row])],
                names=["node", "text", "shingles"],
            )

    return df.mapInArrow(down, "node bigint, text bigint, shingles bigint")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted, of = similarity

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                keep.append(of * both >= wanted * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs)
    if pairs.isEmpty():
        return pairs
    # Only sets that some pair asks for move; what is left may grow with the corpus, so it is never
    # sent to every task.
    sets = _of(sets, pairs.select(c("a").alias("_id")).unionByName(pairs.select(c("b").alias("_id"))))
    one = sets.select(c("text").alias("b0"), c("elements").alias("y")).hint("merge")
    two = sets.select(c("text").alias("a0"), c("elements").alias("x")).hint("merge")
    rows = pairs.join(one, c("b") == c("b0")).select("a", "b", "y").join(two, c("a") == c("a0"))
    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def _of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``text`` is one of ``ids`` (``_id``)."""
    return table.join(small_ids(ids.distinct()), c("text") == c("_id"), "left_semi")


def near_duplicate_sets(
    records: DataFrame, *, key: str = "mix", text: str = "text", shingle: int = 5,
    similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """One row per text: the key, ``n_shingles``, ``component_id`` and ``kept``.

    ``records`` are saved mix files or any table with a whole-number key and a text. Words are
    lower-cased; two texts are linked when their shingle sets have a Jaccard similarity of
    ``similarity`` (numerator, denominator) or more, confirmed on the full sets. The component
    is the smallest key reachable over links. Equal sets are one node of the search, so copies
    cost nothing more. Empty texts and nulls link with nothing; a row with a null key keeps a
    null component and is kept. Rows that share a key are one text's rows and have one
    component. An empty table gives no rows.
    """
    wanted = similarity[0] / similarity[1]
    rows = stored(minwise_signatures(records, key=key, text=text, shingle=shingle))
    full = rows.where((c("n_shingles") > 0) & c(key).isNotNull())
    classes = stored(full.groupBy("set_a", "set_b").agg(F.min(key).alias("text"), F.first("n_shingles").alias("shingles"), F.first("sign").alias("sign")))
    signs = classes.select("text", "shingles", "sign")

    found = _search(records, signs, key, text, shingle, similarity, wanted, recall)
    own = classes.select("set_a", "set_b", "text")
    if found is not None:
        own = own.join(found, c("text") == c("node"), "left").select(
            "set_a", "set_b", F.coalesce("component", "text").alias("text"))
    named = rows.join(
        own.select(c("set_a").alias("_a"), c("set_b").alias("_b"), c("text").alias("_component")),
        (c("set_a") == c("_a")) & (c("set_b") == c("_b")) & (c("n_shingles") > 0), "left",
    )
    component = F.when(c(key).isNotNull(), F.coalesce("_component", key))
    return named.select(
        key, "n_shingles", component.alias("component_id"),
        F.coalesce(component == c(key), F.lit(True)).alias("kept"),
    )


def _search(records, signs, key, text, shingle, similarity, wanted, recall):
    """Components of all linked classes, or None."""
    spark = signs.sparkSession
    trees = shared_trees_for(recall, wanted)
    found = sets = wide = None
    reached, search = FIRST_DEPTH, 0

    def link(links: DataFrame) -> None:
        nonlocal found
        links = stored(links)
        if not links.isEmpty():
            known = links if found is None else links.unionByName(
                found.select(c("node").alias("a"), c("component").alias("b")))
            found = stored(components(known))

    def hold(texts: DataFrame) -> None:
        """Have the full sets of ``texts`` at hand."""
        nonlocal sets
        texts = stored(texts.distinct())
        if sets is not None:
            texts = texts.join(sets.select(c("text").alias("_t")).hint("merge"), c("text") == c("_t"), "left_anti")
        more = _candidate_sets(records, texts, key, text, shingle, spark)
        sets = more if sets is None else sets.unionByName(more)

    # A few trees first, where texts meet the leaders of their nodes only: a group of near copies is
    # one component then, and its nodes in all trees are finished before they give pairs.
    first = stored(_open_nodes(_branch(signs, FIRST_DEPTH, wanted, (1, FIRST_TREES + 1)), None, False))
    if not first.isEmpty():
        hold(first.select("text"))
        link(_confirm(_alike(_leader_pairs(first), signs, wanted), sets, similarity))

    while search < searches_for(recall, wanted, trees, reached) and (search == 0 or wide is not None):
        if search:
            signs = stored(_new_signs(sets, wide, search))
        active = _branch(signs, FIRST_DEPTH, wanted, (1, trees + 1))
        for depth in range(FIRST_DEPTH, DEEPEST + 1):
            rows = stored(_open_nodes(active, found, depth == DEEPEST))
            if rows.isEmpty():
                break
            if depth == FIRST_DEPTH and search == 0:  # what is below or searched again stands in these
                hold(rows.select("text"))
                signs = stored(_of(signs, rows.select(c("text").alias("_id"))))
            tiny = c("size") <= TINY
            pairs = _node_pairs(rows.where(tiny)).unionByName(_leader_pairs(rows.where(~tiny))).distinct()
            link(_confirm(_alike(pairs, signs, wanted), sets, similarity))
            rest = stored(_open_nodes(rows.where(~tiny).select("node", "text", "shingles"), found, depth == DEEPEST))
            if rest.isEmpty():
                break
            link(_compared_nodes(rest.where(~tiny & ~_wide()), signs, sets, similarity, wanted))
            large = rest.where(~tiny & _wide())
            if large.isEmpty():
                break
            if depth == DEEPEST:  # no further branch would split these
                link(_confirm(_alike(_node_pairs(large).distinct(), signs, wanted), sets, similarity))
                break
            if wide is None:
                # All that follows is about these texts.
                wide = stored(large.select("text").distinct())
                signs, sets = (stored(_of(x, wide.select(c("text").alias("_id")))) for x in (signs, sets))
            reached = max(reached, depth + 1)
            active = _branch(
                large.select("node", "text", "shingles").join(signs.select(c("text").alias("_t"), "sign"), c("text") == c("_t"))
                .select("node", "text", "shingles", "sign"), 1, wanted, None)
        search += 1
    return found


def _new_signs(sets: DataFrame, wide: DataFrame, search: int) -> DataFrame:
    """Signatures of the texts in ``wide`` with the coordinates of another search."""
    salt = mix(np.array([search], np.uint64))

    def sign(batches):
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            n = np.array([len(v) for v in values], np.int64)
            if not len(n):
                continue
            low = (mix(np.concatenate(values) ^ salt) >> np.uint64(32)).astype(np.uint32)
            begin = np.cumsum(n) - n
            mins = np.stack([np.minimum.reduceat(low * _SIGN[0, j] + _SIGN[1, j], begin) for j in range(SIGNATURE)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array([m.tobytes() for m in mins], pa.binary())],
                names=["text", "shingles", "sign"])

    own = sets.where(F.length("elements") > 0).join(
        wide.withColumnRenamed("text", "_t").hint("merge"), c("text") == c("_t"), "left_semi")
    return own.select("text", "elements").mapInArrow(sign, "text bigint, shingles bigint, sign binary").distinct()


def _large():
    return (c("size") > TINY) & ((c("size") > SMALL) | (c("weight") > SMALL_SHINGLES))


def _wide():
    """Nodes that branch: those with more signatures or larger sets than one task should hold.

    SMALL * SMALL / SIGNATURE signatures (1 MB) are compared in about a second.
    """
    return (c("size") > SMALL * SMALL // SIGNATURE) | (c("weight") > 2 * SMALL_SHINGLES)


def _open_nodes(active: DataFrame, found: DataFrame | None, deepest: bool) -> DataFrame:
    """Rows (node, text, shingles) of nodes with more than one component, with what is known of
    the node.

    ``weight`` is the number of shingles, ``one`` and ``two`` are texts that lead the node, with their
    components. Of
    nodes with the same texts only one stays where all are compared; those that branch all stay,
    as each of them branches in its own way.
    """
    if found is None:
        rows = active.withColumn("component", c("text"))
    else:
        own = found.withColumnRenamed("node", "_member").hint("merge")
        rows = active.join(own, c("text") == c("_member"), "left").select(
            "node", "text", "shingles", F.coalesce("component", "text").alias("component"))
    rows = stored(rows)
    lead = F.struct(F.xxhash64("node", "text").alias("h"), "text", "component")
    # Sums and extremes, combined before the shuffle.
    nodes = rows.groupBy(c("node").alias("_node")).agg(
        F.count("*").alias("size"), F.sum("shingles").alias("weight"),
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min(lead).alias("one"), F.max(lead).alias("two"),
        F.sum(F.xxhash64("text").cast("decimal(20,0)")).alias("name"),
    ).where("low < high")
    branches = F.when(F.lit(not deepest) & _large(), c("_node"))
    single = nodes.groupBy("name", "size", branches.alias("_branches")).agg(
        F.min(F.struct("_node", "weight", "one", "two")).alias("n")).select("size", "n.*")
    return rows.join(single, c("node") == c("_node")).select(
        "node", "text", "shingles", "component", "size", "weight", "one", "two")


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leader_pairs(rows: DataFrame) -> DataFrame:
    """Each text with up to LEADERS leaders of its nodes in other components, those that it meets most first."""
    one, two = (rows.select("text", "component", c(n)["text"].alias("leader"), c(n)["component"].alias("_other")) for n in ("one", "two"))
    met = one.unionByName(two).where("component <> _other")
    best = Window.partitionBy("text").orderBy(c("n").desc(), F.xxhash64("text", "leader"))
    return (
        met.groupBy("text", "leader").agg(F.count("*").alias("n"))
        .withColumn("_r", F.row_number().over(best)).where(c("_r") <= LEADERS)
        .select(*_ordered("text", "leader"))
    )


def _node_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components inside the nodes."""
    other = rows.select(c("node").alias("_n"), c("text").alias("_t"), c("component").alias("_c"))
    return rows.join(
        other, (c("node") == c("_n")) & (c("text") < c("_t")) & (c("component") != c("_c")),
    ).select(*_ordered("text", "_t"))


def _compared_nodes(rows: DataFrame, signs: DataFrame, sets: DataFrame, similarity, wanted: float) -> DataFrame:
    """Links that join the components inside each node, found on the full sets.

    A node is a group of bounded size; texts that are linked by then are not compared again.
    """
    least = _least(wanted)
    want, of = similarity

    def compare(key, table):
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
        text = table.column("text").to_numpy()
        _, comp = np.unique(table.column("component").to_numpy(), return_inverse=True)
        elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        a, b = [], []
        for i in range(1, len(text)):
            # Earlier texts of other components, by falling agreement: links are found early.
            agree = (sign[:i] == sign[i]).sum(1)
            agree[comp[:i] == comp[i]] = 0
            order = np.argsort(-agree, kind="stable")
            for j in order[: int((agree >= least).sum())].tolist():
                if comp[j] == comp[i]:
                    continue
                x, y = elements[i], elements[j]
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                if of * both >= want * (len(x) + len(y) - both):
                    a.append(min(text[i], text[j]))
                    b.append(max(text[i], text[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def meet(key, table):
        # Signatures alone tell most texts that they have no partner in the node.
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
        _, comp = np.unique(table.column("component").to_numpy(), return_inverse=True)
        has = np.zeros(len(comp), bool)
        for i in range(1, len(comp)):
            near = ((sign[:i] == sign[i]).sum(1) >= least) & (comp[:i] != comp[i])
            has[i] |= near.any()
            has[:i] |= near
        return table.filter(pa.array(has))

    signed = (
        rows.select("node", "text", "component")
        .join(signs.select(c("text").alias("_t"), "sign").hint("merge"), c("text") == c("_t")).drop("_t")
    )
    some = stored(signed.groupBy("node").applyInArrow(meet, signed.schema))
    if some.isEmpty():
        return some.select(c("text").alias("a"), c("text").alias("b"))
    own = _of(sets, some.select(c("text").alias("_id"))).withColumnRenamed("text", "_t").hint("merge")
    full = some.join(own, c("text") == c("_t")).drop("_t")
    return full.groupBy("node").applyInArrow(compare, "a bigint, b bigint").distinct()


def _least(wanted: float) -> float:
    """Coordinates that must agree: five standard deviations below the wanted similarity."""
    return SIGNATURE * wanted - 5 * math.sqrt(SIGNATURE * wanted * (1 - wanted))


def _alike(pairs: DataFrame, signs: DataFrame, wanted: float) -> DataFrame:
    """The pairs whose signatures allow the similarity."""
    least = _least(wanted)

    def close(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for n in "xy")
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    one = signs.select(c("text").alias("a0"), c("sign").alias("x")).hint("merge")
    two = signs.select(c("text").alias("b0"), c("sign").alias("y")).hint("merge")
    return pairs.join(one, c("a") == c("a0")).join(two, c("b") == c("b0")).select("a", "b", "x", "y").mapInArrow(
        close, "a bigint, b bigint")


def _candidate_sets(records, texts, key, text, shingle, spark) -> DataFrame:
    """Full sets (text, elements) of the texts that stand in any node with another one."""
    texts = texts.distinct()
    field = spark.sparkContext.broadcast(
        bit_field(texts.select(F.xxhash64("text").alias("h")), bits_for(texts.count(), FIELD_BITS)))

    def build(batches):
        for batch in batches:
            hit = field.value.has(batch.column("h").to_numpy())
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            keys = batch.column(0)
            for at, to, words in word_slices(batch.column(1), SPACED_LOWER):
                value, bound = _sets(words, shingle)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, to - at),
                     pa.array([value[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])], pa.binary())],
                    names=["text", "elements"],
                )

    picked = records.select(c(f"`{key}`").cast("bigint").alias("text"), c(f"`{text}`").cast("string").alias("t"),
                            F.xxhash64(c(f"`{key}`").cast("bigint")).alias("h")).where(c("text").isNotNull())
    return stored(picked.mapInArrow(build, "text bigint, elements binary"))
