"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a variable with three states: outside of the main text, part of
it, or around it (not part, but with a part below). Its features speak for a state, and each edge of the tree has a potential over parent and child. A sum-product pass
from the leaves up and one from the root down give each element's marginal. All tables are
counts over labelled pages, which Spark adds up. The library has no web pages of its own, so
this works on any table of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelane.llm.dom import Page
from timelane.llm.labelled_pages import MARK, labelled_pages

c = F.col

SMOOTH = 0.5
WEIGHT = 0.6
"""Features of one element lean on each other, so each counts less than its log ratio."""


def _bucket(value: float, *edges: float) -> int:
    return sum(value >= e for e in edges)


def _features(page: Page) -> list[list[str]]:
    """Feature names of each node."""
    nodes = page.nodes
    size, linked, stops = [n.own for n in nodes], [n.linked for n in nodes], [n.stops for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        for total in (size, linked, stops):
            total[nodes[i].parent] += total[i]
    out = []
    for i, n in enumerate(nodes):
        link = linked[i] / size[i] if size[i] else 0.0
        out.append([
            f"tag {n.tag}", f"own {_bucket(n.own, 1, 25, 80, 250)}", f"all {_bucket(size[i], 1, 25, 80, 250, 1000)}",
            f"links {_bucket(link, 0.01, 0.3, 0.7)}", f"stops {_bucket(stops[i], 1, 3, 9)}",
            *{f"name {x}" for x in n.names},
        ])
    return out


OUTSIDE, CONTENT, AROUND = STATES = (0, 1, 2)


def _states(page: Page) -> list[int]:
    """States of the elements of a labelled page."""
    out = [CONTENT if n.marked else OUTSIDE for n in page.nodes]
    for i in range(len(out) - 1, 0, -1):
        if out[i] != OUTSIDE and out[page.nodes[i].parent] == OUTSIDE:
            out[page.nodes[i].parent] = AROUND
    return out


@dataclass(frozen=True)
class TreeModel:
    """Log potentials: of features per state, of edges (by the child's tag) per parent's and
    child's state, of the root."""

    features: dict[str, list[float]]
    edges: dict[str, list[list[float]]]
    any_edge: list[list[float]]
    root: list[float]

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content."""
        nodes = page.nodes
        below = []  # a node's evidence with all that is below it
        for names in _features(page):
            at = [self.features[f] for f in names if f in self.features]
            below.append([WEIGHT * sum(x[k] for x in at) for k in STATES])
        below[0] = [x + y for x, y in zip(below[0], self.root)]
        edge = [self.edges.get(n.tag, self.any_edge) for n in nodes]
        up: list[list[float]] = [[]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            up[i] = [_logsum([e + b for e, b in zip(edge[i][k], below[i])]) for k in STATES]
            to = below[nodes[i].parent]
            for k in STATES:
                to[k] += up[i][k]
        whole = below
        for i in range(1, len(nodes)):
            rest = [p - u for p, u in zip(whole[nodes[i].parent], up[i])]
            down = [_logsum([r + edge[i][k][s] for k, r in enumerate(rest)]) for s in STATES]
            value = [b + d for b, d in zip(whole[i], down)]
            top = max(value)
            whole[i] = [v - top for v in value]
        return [exp(w[CONTENT] - _logsum(w)) for w in whole]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


def train_tree_model(pages: DataFrame, *, html: str = "html", mark: str = MARK) -> TreeModel:
    """Count features and edges over labelled pages.

    ``pages`` has pages whose main text lies in elements with the attribute ``mark``. Null and
    empty pages add nothing; without any page every element has the same odds.
    """
    def count(batches):
        seen: dict[tuple[str, str, int, int], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = Page(text or "", mark)
                states = _states(page)
                for i, (n, names) in enumerate(zip(page.nodes, _features(page))):
                    if n.unseen:
                        continue
                    keys = [("feature", f, 0, states[i]) for f in names] + [("state", "", 0, states[i])]
                    if i:
                        keys.append(("edge", n.tag, states[n.parent], states[i]))
                    for k in keys:
                        seen[k] = seen.get(k, 0) + 1
        if seen:
            kind, name, parent, state = zip(*seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(name), pa.array(parent, pa.int32()), pa.array(state, pa.int32()),
                 pa.array(list(seen.values()), pa.int64())],
                names=["kind", "name", "parent", "state", "n"])

    rows = pages.select(c(html).cast("string")).mapInArrow(
        count, "kind string, name string, parent int, state int, n bigint"
    ).groupBy("kind", "name", "parent", "state").agg(F.sum("n").alias("n"))
    # One row per tag, class name and bucket of the labelled pages.
    table = {(r["kind"], r["name"], r["parent"], r["state"]): r["n"] for r in rows.collect()}
    total = [table.get(("state", "", 0, k), 0) for k in STATES]
    every = [[sum(n for (kind, _, p, s), n in table.items() if kind == "edge" and (p, s) == (parent, state))
              for state in STATES] for parent in STATES]
    back = [[(x + SMOOTH / 10) / (sum(row) + 3 * SMOOTH / 10) for x in row] for row in every]

    def potential(tag: str) -> list[list[float]]:
        """log p(child's state | parent's), drawn to that of all tags where it is rarely seen."""
        out = []
        for parent in STATES:
            n = [table.get(("edge", tag, parent, k), 0) for k in STATES]
            out.append([log((n[k] + back[parent][k]) / (sum(n) + 1)) for k in STATES])
        return out

    features = {
        k[1]: [log((table.get(("feature", k[1], 0, s), 0) + SMOOTH) / (total[s] + 2 * SMOOTH)) for s in STATES]
        for k in table if k[0] == "feature"
    }
    edges = {k[1]: potential(k[1]) for k in table if k[0] == "edge"}
    root = [log((t + SMOOTH) / (sum(total) + 3 * SMOOTH)) for t in total]
    return TreeModel(features, edges, [[log(x) for x in row] for row in back], root)


def default_model(spark: SparkSession) -> TreeModel:
    """Trained on the fixed labelled pages of this package."""
    pages = spark.createDataFrame([(p,) for p in labelled_pages()], "html string")
    return train_tree_model(pages)


def extract_main_text(pages: DataFrame, model: TreeModel, *, html: str = "html") -> DataFrame:
    """All columns of ``pages`` with ``text`` in place of the page (``text`` and ``html`` go).

    Blocks of elements with a content marginal of one half or more, in page order: character
    references decoded, runs of white space as one space, trimmed, joined by a line feed. Null
    and empty pages, and those without content, give an empty text. Equal rows are answered each.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    names = [n for n in pages.columns if n.lower() not in ("text", html.lower())]

    def read(batches):
        for batch in batches:
            texts = []
            for source in batch.column(len(names)).to_pylist():
                page = Page(source or "")
                content = held.value.marginals(page)
                texts.append("\n".join(t for i, t in page.blocks if content[i] >= 0.5))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], pa.array(texts, pa.string())], names=[*names, "text"])

    kept = pages.select(*[c(f"`{n}`") for n in names], c(f"`{html}`").cast("string").alias("_html"))
    return kept.mapInArrow(read, pages.select(*[c(f"`{n}`") for n in names]).schema.add("text", "string"))
