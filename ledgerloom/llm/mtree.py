"""Exact top-k inner products by best-first search in a paged M-tree.

The metric.  With M the greatest squared length of a row, every row x gets one
more component sqrt(M - x.x), and a query q gets 0 there.  Their squared
distance is q.q + M - 2 q.x, so the nearest rows are those of the highest inner
product.  Scores and squared distances between queries and rows are exact
integers; bounds are doubles and are used with a margin beyond their rounding.

The tree.  Routing objects are a bounded sample (``ROUTES`` rows at most, those
with the least hash of their vector): leaf nodes, grouped under the square root
of their number of inner nodes.  Every row is an entry of the leaf with the
nearest routing object and keeps its distance to it (its parent distance); in
the order of these, entries fill pages of ``PAGE_ROWS``.  A page knows the least
and the greatest parent distance in it, a leaf its covering radius and its own
parent distance, an inner node its covering radius.  The sample decides how
even the tree is, never what is found.  Equal vectors are one entry with their
least ids, one more than a query asks for, as none needs further ones.

The search.  A query first reads the page of its nearest leaf that may hold its
nearest entry, which gives a first bound.  Then it goes down the tree: inner
nodes, leaves and pages out of the bound's reach are left out, by covering
radii and by parent distances, before any distance to them is computed.  The
pages that are left meet the queries in tiles (``TILE_ENTRIES`` entries against
``TILE_QUERIES`` queries), in which each query reads its pages in the order of
their lower bounds until none can hold a better entry, and computes products
only with entries whose parent distance allows them.  Tiles bound the memory of
a task whatever the data; where nothing can be pruned all queries meet all rows
in blocks.

Defined cases: rows whose vector is null or holds null or non-finite components
and rows with a null vec_id take no part; repeated rows count once; a query never
gets rows of its own vec_id; shorter vectors are filled up with zeros; an empty
table gives an empty result; other columns are ignored.  Scores tie to the
smaller vec_id.  A component beyond ``MOST`` after scaling is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stored
from .vectors import integers, matrix, padded

SCALE = 256
TOP = 5
#: Queries are the rows whose vec_id is divisible by it.
EACH = 50
#: Leaf nodes, at most; the sample that the upper tree is made of.
ROUTES = 4096
#: Entries for which a leaf node is made.
LEAF_ROWS = 512
PAGE_ROWS = 512
#: Components of the entries, and queries, that meet in a task.
TILE_NUMBERS = 2 << 20
TILE_QUERIES = 4096
#: Components beyond would let a score leave the range of exact doubles.
MOST = 1 << 22
RESULT = "query_id long, q long, vec_id long, score long"


@dataclass
class Tree:
    """The upper tree: routing objects and what the nodes below them hold.  At most ROUTES leaf nodes."""

    size: int  # components of a vector
    squared: float  # M
    routes: np.ndarray  # routing objects with the further component
    inner: np.ndarray  # the routes that are inner nodes
    parent: np.ndarray  # of a leaf: its inner node's place in ``inner``
    apart: np.ndarray  # of a leaf: its parent distance
    radius: np.ndarray  # of a leaf
    reach: np.ndarray  # of an inner node: its covering radius
    rows: np.ndarray  # entries of a leaf

    @property
    def margin(self) -> float:
        """More than the rounding of any distance."""
        return 1e-6 * (1 + self.squared**0.5)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Rows with their further component."""
        more = np.sqrt(np.maximum(self.squared - np.einsum("ij,ij->i", vectors, vectors), 0))
        return np.hstack([vectors, more[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of a and of b."""
    squared = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0))


def entries_of(rows: DataFrame, top: int) -> DataFrame:
    """v and ids (the least ``top + 1``) of every distinct vector."""
    # The limit by rank is pushed below the exchange, so a vector with most of the rows sends few.
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("__n", least).filter(F.col("__n") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def upper_tree(entries: DataFrame, size: int, squared: int, count: int) -> Tree:
    """The routing objects and their parent distances; radii and rows are still to come."""
    wanted = int(min(ROUTES, max(1, -(-count // LEAF_ROWS))))
    sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).toArrow()  # ROUTES rows at most
    tree = Tree(size, float(squared), *[np.zeros(0)] * 7)
    tree.routes = tree.lifted(matrix(sample.column("v").combine_chunks(), size).astype(np.float64))
    tree.inner = np.arange(int(np.ceil(len(tree.routes) ** 0.5)))
    far = distances(tree.routes, tree.routes[tree.inner])
    tree.parent, tree.apart = far.argmin(1), far.min(1)
    return tree


def placed(entries: DataFrame, tree: Tree) -> DataFrame:
    """Entries with leaf and far (their parent distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = distances(tree.lifted(matrix(batch.column("v"), tree.size).astype(np.float64)), tree.routes)
                leaf = far.argmin(1)
                columns = [batch.column("v"), batch.column("ids"), pa.array(leaf.astype(np.int32)), pa.array(far.min(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["v", "ids", "leaf", "far"])

    return entries.mapInArrow(run, "v array<long>, ids array<long>, leaf int, far double")


def build(entries: DataFrame, size: int, squared: int, count: int) -> tuple[Tree, DataFrame, DataFrame]:
    """(upper tree, entries by page, pages): entries have leaf, page, far, ids, v; pages leaf, page, low, high."""
    tree = upper_tree(entries, size, squared, count)
    known = stored(placed(entries, tree), "mtree-entries")
    by_leaf = known.groupBy("leaf").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows")).toPandas()  # ROUTES rows at most
    tree.radius, tree.rows = np.full(len(tree.routes), -np.inf), np.zeros(len(tree.routes), np.int64)
    tree.radius[by_leaf["leaf"]], tree.rows[by_leaf["leaf"]] = by_leaf["radius"], by_leaf["rows"]
    tree.reach = np.full(len(tree.inner), -np.inf)
    np.maximum.at(tree.reach, tree.parent, tree.apart + tree.radius)
    # Ranks in steps of the distance, so a leaf with most of the rows is many tasks.
    step = max(float(squared), 1.0) ** 0.5 / 4096
    order = ranked(known, ["leaf"], [F.col("far"), F.col("v")], F.floor(F.col("far") / step), "at")
    paged = stored(order.withColumn("page", F.floor(F.col("at") / PAGE_ROWS).cast("int")).drop("at"), "mtree-pages")
    pages = paged.groupBy("leaf", "page").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    return tree, paged, stored(pages, "mtree-directory")


def nearest_leaves(queries: DataFrame, tree: Tree) -> DataFrame:
    """Queries with leaf and near: the nearest leaf that has entries, and the distance to its routing object."""
    filled = np.flatnonzero(tree.rows)
    flat = tree.routes[filled]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = matrix(batch.column("v"), tree.size).astype(np.float64)
                far = distances(np.hstack([q, np.zeros((len(q), 1))]), flat)
                columns = [*batch.columns, pa.array(filled[far.argmin(1)].astype(np.int32)), pa.array(far.min(1))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "leaf", "near"])

    return queries.mapInArrow(run, "query_id long, q long, v array<long>, leaf int, near double")


def reachable(queries: DataFrame, tree: Tree) -> DataFrame:
    """(q, leaf, near) of the leaves that may hold an entry within ``bound`` of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch.column("v"), tree.size).astype(np.float64)
            q = np.hstack([q, np.zeros((len(q), 1))])
            bound = batch.column("bound").to_numpy(zero_copy_only=False) + tree.margin
            up = distances(q, tree.routes[tree.inner])
            rows, leaves, near = [], [], []
            for node in range(len(tree.inner)):
                below = np.flatnonzero((tree.parent == node) & (tree.rows > 0))
                into = np.flatnonzero(up[:, node] - tree.reach[node] <= bound)
                if not len(below) or not len(into):
                    continue
                # By parent distances, before a distance to a leaf is computed.
                maybe = np.abs(up[into, node][:, None] - tree.apart[below]) - tree.radius[below] <= bound[into][:, None]
                into, below = into[maybe.any(1)], below[maybe.any(0)]
                if len(into):
                    far = distances(q[into], tree.routes[below])
                    i, j = np.nonzero(far - tree.radius[below] <= bound[into][:, None])
                    rows.append(into[i])
                    leaves.append(below[j])
                    near.append(far[i, j])
            if rows:
                ids = batch.column("q").take(pa.array(np.concatenate(rows)))
                columns = [ids, pa.array(np.concatenate(leaves).astype(np.int32)), pa.array(np.concatenate(near))]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "leaf", "near"])

    return queries.mapInArrow(run, "q long, leaf int, near double")


class Page:
    """Entries of a page in the order of their parent distances."""

    def __init__(self, table: pa.Table, size: int) -> None:
        table = table.sort_by("far")
        self.far = table.column("far").to_numpy()
        self.vectors = matrix(table.column("v").combine_chunks(), size).astype(np.float64)
        ids = table.column("ids").combine_chunks()
        self.ids, self.at = ids.values.to_numpy(), ids.offsets.to_numpy()

    def scores(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
        """(products, first entry) with the entries whose parent distance one of the queries allows."""
        first, last = np.searchsorted(self.far, low.min(), "left"), np.searchsorted(self.far, high.max(), "right")
        return queries @ self.vectors[first:last].T, int(first)


class Best:
    """The best ``top`` candidates of a query."""

    def __init__(self, own: int, bound: float, top: int) -> None:
        self.own, self.bound, self.top, self.found = own, bound, top, []

    def offer(self, page: Page, scores: np.ndarray, first: int) -> None:
        """``bound``: the least score that may still enter."""
        for i in np.flatnonzero(scores >= self.bound):
            a, b = page.at[first + i], page.at[first + i + 1]
            self.found += [(-int(scores[i]), int(x)) for x in page.ids[a:b] if x != self.own]
        self.found = sorted(self.found)[: self.top]
        if len(self.found) == self.top:
            self.bound = max(self.bound, -self.found[-1][0])


def search_tile(queries: pa.Table, entries: pa.Table, size: int, squared: float, margin: float, top: int) -> pa.Table:
    """Best-first search of the queries of a tile among its pages."""
    places = pa.StructArray.from_arrays([entries.column(c).combine_chunks() for c in ("leaf", "page")], ["leaf", "page"])
    keys = places.field("leaf").to_numpy().astype(np.int64) << 32 | places.field("page").to_numpy()
    order = np.argsort(keys, kind="stable")
    names, starts = np.unique(keys[order], return_index=True)
    pages = {k: Page(entries.take(pa.array(rows)), size) for k, rows in zip(names.tolist(), np.split(order, starts[1:]))}
    vectors = matrix(queries.column("v").combine_chunks(), size).astype(np.float64)
    lengths = np.einsum("ij,ij->i", vectors, vectors) + squared
    least = queries.column("least").to_numpy()
    own = queries.column("query_id").to_pylist()
    best = [Best(o, s, top) for o, s in zip(own, least.tolist())]
    # Of each query the pages in the order of their lower bounds.
    ahead = [sorted((w["bound"], w["leaf"] << 32 | w["page"], w["near"]) for w in x) for x in queries.column("wants").to_pylist()]
    going = list(range(len(best)))
    for wave in range(max(map(len, ahead), default=0)):
        # A query whose next page is out of reach is done, as are those after it.
        reach = {i: np.sqrt(max(lengths[i] - 2 * best[i].bound, 0.0)) + margin for i in going}
        going = [i for i in going if wave < len(ahead[i]) and ahead[i][wave][0] <= reach[i]]
        by_page: dict[int, list[int]] = {}
        for i in going:
            by_page.setdefault(ahead[i][wave][1], []).append(i)
        for name, some in by_page.items():
            near, wide = np.array([ahead[i][wave][2] for i in some]), np.array([reach[i] for i in some])
            scores, first = pages[name].scores(vectors[some], near - wide, near + wide)
            for i, s in zip(some, scores):
                best[i].offer(pages[name], s, first)
    q = queries.column("q").to_pylist()
    rows = [(own[i], q[i], vec, -minus) for i, b in enumerate(best) for minus, vec in b.found]
    columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
    return pa.table(columns, names=["query_id", "q", "vec_id", "score"])


def search(wants: DataFrame, queries: DataFrame, paged: DataFrame, tree: Tree, top: int) -> DataFrame:
    """Results of the tiles.  ``wants``: q, leaf, page, near, bound (lower); ``queries``: q, query_id, v, least, tile."""
    entries_a_tile = max(PAGE_ROWS, TILE_NUMBERS // max(tree.size, 1))
    before = np.concatenate([[0], np.cumsum(tree.rows)])[:-1].tolist()  # ROUTES numbers
    start = F.get(F.lit(before).cast("array<long>"), F.col("leaf"))
    tiled = wants.join(queries.select("q", "tile"), "q").withColumn("block", F.floor((start + F.col("page") * PAGE_ROWS) / entries_a_tile))
    tiled = stored(tiled, "mtree-wants")
    asked = tiled.groupBy("tile", "block", "q").agg(F.collect_list(F.struct("leaf", "page", "near", "bound")).alias("wants"))
    mine = asked.join(queries.drop("tile"), "q").select("tile", "block", "q", "query_id", "v", "least", "wants")
    theirs = tiled.select(F.col("tile").alias("t"), F.col("block").alias("b"), "leaf", "page").distinct().join(paged, ["leaf", "page"])
    theirs = theirs.select("t", "b", "leaf", "page", "far", "ids", "v")
    size, squared, margin = tree.size, tree.squared, tree.margin

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_tile(left, right, size, squared, margin, top)

    return mine.groupBy("tile", "block").cogroup(theirs.groupBy("t", "b")).applyInArrow(run, RESULT)


def _lower(near: Column) -> Column:
    """The least distance that an entry of a page can have, by its parent distances."""
    return F.greatest(near - F.col("high"), F.col("low") - near, F.lit(0.0))


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_products(vectors: DataFrame, top: int = TOP, scale: int = SCALE, each: int = EACH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``top`` rows for every row whose vec_id is divisible by ``each``."""
    rows = integers(vectors, scale, MOST).filter("vec_id IS NOT NULL")
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    rows = stored(rows.withColumn("v", padded(F.col("v"), size)), "mtree-rows")
    entries = stored(entries_of(rows.distinct(), top), "mtree-classes")
    length = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    count, squared = entries.agg(F.count(F.lit(1)), F.coalesce(F.max(length), F.lit(0))).first()
    if squared > 1 << 52:
        raise ValueError("vectors are too long for exact scores in doubles")
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tree, paged, pages = build(entries, size, squared, count)
    asked = rows.filter(F.col("vec_id") % each == 0).distinct()
    asked = asked.select(F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("q"), "v")  # stays as it is written
    asked = stored(nearest_leaves(asked, tree), "mtree-queries")
    # Queries of a leaf and its neighbours share a tile.
    counts = dict(asked.groupBy("leaf").count().collect())  # ROUTES rows at most
    sums = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(len(tree.routes))])])
    start, held = (F.get(F.lit(x).cast("array<long>"), F.col("leaf")) for x in (sums[:-1].tolist(), np.maximum(np.diff(sums), 1).tolist()))
    asked = asked.withColumn("tile", F.floor((start + F.pmod(F.xxhash64("q"), held)) / TILE_QUERIES))
    # The first page of each query: that of its nearest leaf with the least bound.
    first = asked.join(pages, "leaf").withColumn("bound", _lower(F.col("near")))
    first = first.groupBy("q").agg(F.min_by(F.struct("leaf", "page", "near", "bound"), F.struct("bound", "page")).alias("w")).select("q", "w.*")
    first = stored(first, "mtree-first")
    unbound = asked.select("q", "query_id", "v", "tile", F.lit(-float("inf")).alias("least"))
    met = stored(search(first, unbound, paged, tree, top), "mtree-met")
    bounds = met.groupBy("q").agg(F.when(F.count(F.lit(1)) == top, F.min("score")).alias("least"))
    known = asked.select("q", "query_id", "v", "tile").join(bounds, "q", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(-float("inf"))))
    squared_reach = length.cast("double") + F.lit(float(squared)) - 2 * F.col("least")
    known = stored(known.withColumn("bound", F.sqrt(F.greatest(squared_reach, F.lit(0.0)))), "mtree-bounds")
    into = reachable(known.select("q", "v", "bound"), tree).join(pages, "leaf").withColumn("lower", _lower(F.col("near")))
    into = into.join(known.select("q", F.col("bound").alias("most")), "q").filter(F.col("lower") <= F.col("most") + tree.margin)
    into = into.join(first.select("q", "leaf", "page"), ["q", "leaf", "page"], "left_anti")
    rest = search(into.select("q", "leaf", "page", "near", F.col("lower").alias("bound")), known.drop("bound"), paged, tree, top)
    out = _best(met.unionByName(rest), top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = f"""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    v AS (SELECT DISTINCT vec_id, [floor({SCALE} * c) for c in x] AS v FROM e
          WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len([c for c in x if c IS NULL OR NOT isfinite(c)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v AS q JOIN v AS c ON q.vec_id % {EACH} = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
