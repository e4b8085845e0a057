"""Phylogenetic trees: newick texts, column likelihoods as polynomials, splits and distances in tree space."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Node:
    d: float = 0.0
    name: str = ""
    children: list[Node] = field(default_factory=list)


def parse_newick(text: str) -> Node:
    """One tree; a name or a length may be missing. Raises ValueError where brackets don't match."""
    parts = re.findall(r"[(),;:]|[^(),;:\s]+", text)
    stack, node, k = [], Node(), 0
    while k < len(parts):
        t = parts[k]
        if t == "(":
            stack.append(node)
            node = Node()
            stack[-1].children.append(node)
        elif t in ",)":
            if not stack:
                raise ValueError("unmatched bracket in tree")
            if t == ",":
                node = Node()
                stack[-1].children.append(node)
            else:
                node = stack.pop()
        elif t == ":":
            k += 1
            node.d = float(parts[k])
        elif t != ";":
            node.name = t
        k += 1
    if stack:
        raise ValueError("unmatched bracket in tree")
    return node


def to_newick(node: Node) -> str:
    """Six decimals; an inner edge of length 0 is left out, its children stand in its parent's list."""

    def parts(n: Node) -> Iterator[str]:
        for c in n.children:
            if c.children and c.d == 0 and not c.name:
                yield from parts(c)
            else:
                yield (f"({','.join(parts(c))})" if c.children else "") + f"{c.name}:{c.d:.6f}"

    return (f"({','.join(parts(node))})" if node.children else "") + node.name + ";"


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def find(root: Node, name: str) -> Node | None:
    """The node of that name, above its descendants; the first of several."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.name == name:
            return n
        stack += reversed(n.children)
    return None


def leaf_numbers(root: Node, reference: list[str]) -> dict[str, int]:
    """Numbers of a tree's leaves as those of a reference tree; both must have the same leaves, each once."""
    found = [x.name for x in leaves(root)]
    if sorted(found) != sorted(reference):
        raise ValueError("the trees differ in their leaves")
    number = {n: k for k, n in enumerate(reference)}
    return {n: number[n] for n in found}


def tree_of_splits(edges: dict[int, float], lengths: list[float], names: list[str]) -> Node:
    """The tree of compatible edges (masks without leaf 0): each edge below the smallest one that holds it, leaf 0 as the root's last child."""
    root, nodes = Node(), {}
    order = sorted(edges, key=lambda m: (-m.bit_count(), m))
    for k, m in enumerate(order):
        nodes[m] = Node(edges[m])
        above = [x for x in order[:k] if m & ~x == 0]
        if any(m & x and m & ~x for x in order[:k]):
            raise ValueError("edges that can't be in one tree")
        (nodes[above[-1]] if above else root).children.append(nodes[m])
    for leaf in range(1, len(names)):
        above = [x for x in order if x >> leaf & 1]
        (nodes[above[-1]] if above else root).children.append(Node(lengths[leaf], names[leaf]))
    root.children.append(Node(lengths[0], names[0]))
    return root


def newick_of_splits(splits: DataFrame, names: list[str]) -> DataFrame:
    """(tree, newick) from (tree, kind, mask, d): rows of inner edges (``split``: their mask) and of leaves (``leaf``: their number). A leaf without a row has length 0."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                lengths = [0.0] * len(names)
                for e in own:
                    if e["kind"] == "leaf":
                        lengths[e["mask"]] = e["d"]
                texts.append(to_newick(tree_of_splits({e["mask"]: e["d"] for e in own if e["kind"] == "split"}, lengths, names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["tree", "newick"])

    # a tree is one row: it has fewer than two edges per leaf
    own = splits.groupBy(F.col("tree").cast("long").alias("tree")).agg(F.collect_list(F.struct("kind", F.col("mask").cast("long").alias("mask"), F.col("d").cast("double").alias("d"))).alias("own"))
    return own.mapInArrow(written, "tree long, newick string")


Poly = dict[tuple[int, ...], float]


def _times(a: Poly, b: Poly, scale: float) -> Poly:
    out: Poly = {}
    for e, x in a.items():
        for f, y in b.items():
            g = tuple(i + j for i, j in zip(e, f))
            out[g] = out.get(g, 0.0) + scale * x * y
    return out


def _add(*polys: Poly) -> Poly:
    out: Poly = {}
    for p in polys:
        for e, x in p.items():
            out[e] = out.get(e, 0.0) + x
    return {e: x for e, x in out.items() if x}


def column_polynomial(root: Node, codes: dict[str, int], letters: int) -> Poly:
    """The likelihood of one column as a polynomial in the letters' stationary probabilities.

    Each node carries, by letter, the part in which its letter reaches it unmutated, and a closed part. A last
    child of the root that is a leaf is the outgroup; a leaf with code -1 is missing data.
    """
    zero = (0,) * letters
    unit = [tuple(int(i == k) for i in range(letters)) for k in range(letters)]

    def total(c: list[Poly]) -> Poly:
        return _add(c[letters], *(_times({unit[k]: 1.0}, c[k], 1.0) for k in range(letters)))

    def join(a: list[Poly], pa_: float, b: list[Poly], pb: float) -> list[Poly]:
        sa, sb, qa, qb = total(a), total(b), 1 - pa_, 1 - pb
        la, lb = _add(_times(a[letters], {zero: 1.0}, qa), _times(sa, {zero: 1.0}, pa_)), _add(_times(b[letters], {zero: 1.0}, qb), _times(sb, {zero: 1.0}, pb))
        out = [_add(_times(a[k], lb, qa), _times(la, b[k], qb), _times(a[k], b[k], qa * qb)) for k in range(letters)]
        return [*out, _times(la, lb, 1.0)]

    def up(n: Node) -> list[Poly]:
        if not n.children:
            k = codes.get(n.name, -1)
            return [{zero: 1.0} if i == (letters if k < 0 else k) else {} for i in range(letters + 1)]
        value, p = up(n.children[0]), -math.expm1(-n.children[0].d)
        for c in n.children[1:]:
            value, p = join(value, p, up(c), -math.expm1(-c.d)), 0.0
        return value

    return total(up(root))


def pruned_polynomial(root: Node, codes: dict[str, int], letters: int) -> Poly:
    """The same polynomial by pruning, letter by letter of every inner node; it has many more terms on the way. No outgroup, no missing data."""
    unit = [tuple(int(i == k) for i in range(letters)) for k in range(letters)]
    zero = (0,) * letters

    def below(n: Node) -> list[Poly]:
        """By letter of ``n``: what lies below it."""
        out = [{zero: 1.0}] * letters
        for c in n.children:
            p = -math.expm1(-c.d)
            inner = below(c) if c.children else [{zero: 1.0} if j == codes[c.name] else {} for j in range(letters)]
            fresh = _add(*(_times({unit[j]: p}, x, 1.0) for j, x in enumerate(inner)))
            out = [_times(out[i], _add(fresh, _times(inner[i], {zero: 1.0}, 1 - p)), 1.0) for i in range(letters)]
        return out

    return _add(*(_times({unit[j]: 1.0}, x, 1.0) for j, x in enumerate(below(root))))


def value_at(poly: Poly, theta: list[float]) -> float:
    return sum(c * math.prod(t**e for t, e in zip(theta, es)) for es, c in poly.items())


def log_posterior_density(poly: Poly, alpha: list[float], theta: list[float]) -> float:
    """Log density of the letters' probabilities given a column, at ``theta``."""
    prior = math.lgamma(sum(alpha)) + sum((a - 1) * math.log(t) - math.lgamma(a) for a, t in zip(alpha, theta))
    return math.log(value_at(poly, theta)) + prior - log_marginal(poly, alpha)


def comb_tree(n: int) -> Node:
    """A comb of n inner joins of unit branches, with a unit leaf beside it at the root."""
    last = Node(1.0, "x0")
    for k in range(1, n):
        last = Node(1.0, "", [last, Node(1.0, f"x{k}")])
    return Node(0.0, "", [last, Node(1.0, f"x{n}")])


def expected_terms(spark: SparkSession, sizes: list[int], columns: int = 1000, letters: int = 4, prune: bool = False, seed: int = 0) -> DataFrame:
    """(x, terms): mean number of terms of the polynomials of random columns on combs; x = 2 n - 1. Draws depend on the seed alone."""
    evaluate = pruned_polynomial if prune else column_polynomial

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for n, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng, tree = random.Random(seed * 1_000_003 + n * 10_007 + k), comb_tree(n)
                codes = {x.name: rng.randrange(letters) for x in leaves(tree)}
                terms.append(len(evaluate(tree, codes, letters)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.int64())], ["n", "terms"])

    todo = spark.createDataFrame([(n,) for n in sizes], "n int").join(spark.range(columns)).select("n", F.col("id").alias("k"))
    rows = todo.repartition(spark.sparkContext.defaultParallelism).mapInArrow(counted, "n int, terms long")
    return rows.groupBy((2 * F.col("n") - 1).alias("x")).agg(F.avg("terms").alias("terms"))


def log_marginal(poly: Poly, alpha: list[float]) -> float:
    """Log of the polynomial's mean under a Dirichlet distribution; letters without prior weight and count are left out."""

    def beta(v: list[float]) -> float:
        v = [x for x in v if x > 0]
        return sum(map(math.lgamma, v)) - math.lgamma(sum(v))

    terms = [math.log(c) + beta([e + a for e, a in zip(es, alpha)]) - beta(alpha) for es, c in poly.items() if c > 0]
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms))


def expectation(poly: Poly, alpha: list[float]) -> list[float]:
    """Posterior mean of the letters' probabilities."""
    base = log_marginal(poly, alpha)
    out = []
    for k in range(len(alpha)):
        more = {tuple(e + (i == k) for i, e in enumerate(es)): c for es, c in poly.items()}
        out.append(math.exp(log_marginal(more, alpha) - base))
    return out


def pattern_likelihoods(patterns: DataFrame, newick: str, taxa: list[str], alpha: list[float]) -> DataFrame:
    """``logml`` and the expected probabilities of each distinct column (codes, n): one evaluation per pattern."""

    def evaluated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = parse_newick(newick)
        known: dict[tuple, tuple[float, list[float], int]] = {}

        def of(codes: list[int]) -> tuple[float, list[float], int]:
            """Columns that differ in the names of letters of the same prior weights are one evaluation."""
            letters = list(dict.fromkeys(c for c in codes if c >= 0))
            letters += [k for k in range(len(alpha)) if k not in letters]
            place = {c: k for k, c in enumerate(letters)}
            own, prior = tuple(place.get(c, -1) for c in codes), [alpha[k] for k in letters]
            found = known.get((own, *prior))
            if found is None:
                if len(known) > 50_000:
                    known.clear()
                poly = column_polynomial(root, dict(zip(taxa, own)), len(alpha))
                found = known[(own, *prior)] = log_marginal(poly, prior), expectation(poly, prior), len(poly)
            return found[0], [found[1][place[k]] for k in range(len(alpha))], found[2]

        for batch in batches:
            rows = [of(c) for c in batch.column(0).to_pylist()]
            logs, means, terms = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.list_(pa.float64()), pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, logs, means, terms], ["codes", "n", "logml", "expectation", "n_terms"])

    return patterns.select("codes", F.col("n").cast("long").alias("n")).mapInArrow(evaluated, "codes array<int>, n long, logml double, expectation array<double>, n_terms long")


def splits_of(root: Node, names: list[str]) -> tuple[dict[int, float], list[float]]:
    """Internal edges as masks of the leaves below them (never with leaf 0), with lengths, and the leaves' lengths."""
    number = {n: k for k, n in enumerate(names)}
    edges: dict[int, float] = {}
    lengths = [0.0] * len(names)

    def down(n: Node) -> int:
        if not n.children:
            lengths[number[n.name]] = n.d
            return 1 << number[n.name]
        mask = 0
        for c in n.children:
            m = down(c)
            mask |= m
            if c.children and c.d > 0:
                side = m if not m & 1 else ((1 << len(names)) - 1) ^ m
                if 1 < bin(side).count("1") < len(names) - 1:
                    edges[side] = edges.get(side, 0.0) + c.d
        return mask

    down(root)
    return edges, lengths


_LENGTH = re.compile(r":\s*([^(),;:\s]+)")


def length_places(text: str, names: list[str]) -> list[tuple[int, int, int]]:
    """Where a text's lengths belong: (place of the length from 1 on, number of the leaf or -1, mask or 0), from the leaves up."""
    count = itertools.count(1)
    root, found = parse_newick(_LENGTH.sub(lambda _: f":{next(count)}", text)), []

    def down(n: Node) -> int:
        if not n.children:
            leaf = names.index(n.name)
            found.append((int(n.d), leaf, 0))
            return 1 << leaf
        mask = 0
        for c in n.children:
            mask |= (m := down(c))
            side = m if not m & 1 else ((1 << len(names)) - 1) ^ m
            if c.children and c.d and 1 < side.bit_count() < len(names) - 1:
                found.append((int(c.d), -1, side))
        return mask

    down(root)
    return found


def split_reader(names: list[str]) -> Callable[[str], tuple[dict[int, float], list[float]]]:
    """``splits_of`` a text. Where the lengths of a text belong is looked up once for texts that differ in lengths alone."""
    known: dict[str, list[tuple[int, int, int]]] = {}

    def read(text: str) -> tuple[dict[int, float], list[float]]:
        parts = _LENGTH.split(text)
        shape, values = ":".join(parts[::2]), [0.0, *map(float, parts[1::2])]
        own = known.get(shape)
        if own is None:
            if len(known) > 10_000:
                known.clear()
            own = known[shape] = length_places(text, names)
        edges: dict[int, float] = {}
        lengths = [0.0] * len(names)
        for k, leaf, side in own:
            if leaf >= 0:
                lengths[leaf] = values[k]
            elif values[k] > 0:
                edges[side] = edges.get(side, 0.0) + values[k]
        return edges, lengths

    return read


#: Texts of one shape from which on their lengths are read side by side.
SHAPE_TEXTS = 50


def array_reader(names: list[str]) -> Callable[[pa.Array], tuple[list[int], np.ndarray] | None]:
    """``splits_of`` many texts: the masks in order, and an array with a row for each (0: no such edge), then one for each leaf, and a column for each text.

    None for texts of many shapes, with letters beyond printable ASCII, or with lengths that only Python reads; ``split_reader`` takes those.
    """

    def read(texts: pa.Array) -> tuple[list[int], np.ndarray] | None:
        if pc.any(pc.match_substring_regex(texts, r"[^ -~]")).as_py():
            return None
        shapes = pc.replace_substring_regex(texts, _LENGTH.pattern, ":").dictionary_encode()
        if SHAPE_TEXTS * len(shapes.dictionary) > max(len(texts), SHAPE_TEXTS):
            return None
        of, edges, leaves = shapes.indices.to_numpy(), {}, np.zeros((len(names), len(texts)))
        for k in range(len(shapes.dictionary)):
            rows = np.flatnonzero(of == k)
            own = texts.take(pa.array(rows))
            parts = [re.escape(x) for x in _LENGTH.split(own[0].as_py())[::2]]
            pattern = parts[0] + "".join(f":[\\s]*(?P<v{j}>[^(),;:\\s]+){x}" for j, x in enumerate(parts[1:], 1))
            places = length_places(own[0].as_py(), names)
            found = pc.extract_regex(own, f"^{pattern}$") if len(parts) > 1 else None
            if found is not None and found.null_count:
                return None
            for j, leaf, side in places:
                try:
                    values = found.field(j - 1).cast(pa.float64()).to_numpy() if j else 0.0
                except pa.ArrowInvalid:
                    return None
                if leaf >= 0:
                    leaves[leaf, rows] = values
                else:
                    edges.setdefault(side, np.zeros(len(texts)))[rows] += np.where(values > 0, values, 0.0)
        masks = sorted(m for m, d in edges.items() if d.any())
        return masks, np.stack([*(edges[m] for m in masks), *leaves])

    return read


def _compatible(a: int, b: int) -> bool:
    return not a & b or not a & ~b or not b & ~a


def _cover(a: list[int], b: list[int], wa: dict[int, float], wb: dict[int, float]) -> tuple[float, set[int], set[int]]:
    """Lightest vertex cover of the incompatibility graph between two sets of splits, by the largest flow through it."""
    graph: dict[object, dict[object, float]] = {"s": {("a", x): wa[x] for x in a}, "t": {}}
    for x in a:
        graph["a", x] = {("b", y): math.inf for y in b if not _compatible(x, y)}
    for y in b:
        graph["b", y] = {"t": wb[y]}
    flow = 0.0
    while True:
        before: dict[object, object] = {"s": None}
        queue = ["s"]
        while queue and "t" not in before:
            u = queue.pop(0)
            for v, room in graph[u].items():
                if room > 1e-12 and v not in before:
                    before[v] = u
                    queue.append(v)
        if "t" not in before:
            return flow, {x for x in a if ("a", x) not in before}, {y for y in b if ("b", y) in before}
        path, v = [], "t"
        while v != "s":
            path.append((before[v], v))
            v = before[v]
        x = min(graph[u][v] for u, v in path)
        for u, v in path:
            graph[u][v] -= x
            graph[v][u] = graph[v].get(u, 0.0) + x
        flow += x


def _norm(edges: list[int], d: dict[int, float]) -> float:
    return math.sqrt(sum(d[x] ** 2 for x in edges))


Edges = dict[int, float]


@dataclass
class Geodesic:
    """The shortest path between two trees, each given by its internal edges and its leaves' lengths.

    ``supports`` are the pairs of edge sets (of the first tree, of the second) that replace each other;
    ``common`` holds, with both lengths, edges that both trees have or that one has and the other could have at length 0.
    """

    first: Edges
    second: Edges
    leaves: list[tuple[float, float]]
    common: dict[int, tuple[float, float]]
    supports: list[tuple[list[int], list[int]]]

    def length(self) -> float:
        square = sum((x - y) ** 2 for x, y in [*self.common.values(), *self.leaves])
        return math.sqrt(square + sum((_norm(x, self.first) + _norm(y, self.second)) ** 2 for x, y in self.supports))

    def point(self, share: float) -> tuple[Edges, list[float]]:
        """The tree at ``share`` of the way."""
        between = lambda x, y: (1 - share) * x + share * y
        edges = {e: between(x, y) for e, (x, y) in self.common.items()}
        for a, b in self.supports:
            left, grown = (1 - share) * _norm(a, self.first), share * _norm(b, self.second)
            if left > grown:
                edges |= {e: self.first[e] * (left - grown) / _norm(a, self.first) for e in a}
            else:
                edges |= {e: self.second[e] * (grown - left) / _norm(b, self.second) for e in b}
        return {e: d for e, d in edges.items() if d > 0}, [between(x, y) for x, y in self.leaves]


def geodesic(one: tuple[Edges, list[float]], two: tuple[Edges, list[float]]) -> Geodesic:
    """Pieces between common edges, refined by lightest covers until none is lighter than 1."""
    (e1, l1), (e2, l2) = one, two
    both = set(e1) & set(e2)
    free = lambda own, other: [x for x in own if x not in both and all(_compatible(x, y) for y in other)]
    f1, f2 = free(e1, e2), free(e2, e1)  # edges that the other tree could simply have, at length 0
    common = {x: (e1.get(x, 0.0), e2.get(x, 0.0)) for x in [*both, *f1, *f2]}
    pieces: dict[int, tuple[list[int], list[int]]] = {}
    for side, own in enumerate((e1, e2)):
        for x in own:
            if x not in common:
                border = min((y for y in sorted(common) if not x & ~y), key=lambda y: y.bit_count(), default=0)
                pieces.setdefault(border, ([], []))[side].append(x)
    supports = []
    for a, b in pieces.values():
        path, k = [(a, b)], 0
        while k < len(path):
            x, y = path[k]
            nx, ny = _norm(x, e1), _norm(y, e2)
            if not x or not y:
                k += 1
                continue
            weight, ca, cb = _cover(x, y, {i: (e1[i] / nx) ** 2 for i in x}, {i: (e2[i] / ny) ** 2 for i in y})
            if weight < 1 - 1e-6:
                path[k : k + 1] = [(sorted(ca), [i for i in y if i not in cb]), ([i for i in x if i not in ca], sorted(cb))]
            else:
                k += 1
        supports += path
    return Geodesic(e1, e2, list(zip(l1, l2)), common, supports)


def geodesic_length(t1: Node, t2: Node, names: list[str]) -> float:
    return geodesic(splits_of(t1, names), splits_of(t2, names)).length()


def geodesic_pairs(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``distance`` for rows (i, j, first, second) of newick texts over the same leaves."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [geodesic_length(parse_newick(x), parse_newick(y), names) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], ["i", "j", "distance"])

    return pairs.select("i", "j", "first", "second").mapInArrow(measured, "i long, j long, distance double")


def read_newick(spark, path: str) -> DataFrame:
    """(value): one row per tree of text files whose trees end in semicolons."""
    return spark.read.option("lineSep", ";").text(path).where(F.trim("value").contains("("))
