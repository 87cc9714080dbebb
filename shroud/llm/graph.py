"""Connected components of a table of links, by alternating star operations.

Each task first replaces the links it reads by a forest that connects the same
ids (a buffer of ``LINKS`` links at a time, so its memory is bounded); what is
shuffled is that forest.  A table of at most ``LINKS`` links is done when one
task has read it.  Beyond that, each round is two joins and two grouped minima;
nothing is gathered per node, so a node with very many links costs no more than
its links.  Rounds end when each component is a star (about the logarithm of
the longest chain).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LINKS = 1 << 18


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of each of ``n`` ids' component under the links ``a`` - ``b``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))       # a root joins the least root it is linked with
        while (label[label] != label).any():
            label = label[label]


def _forest(links: DataFrame) -> DataFrame:
    """``a, b`` with ``a > b``: links that connect the same ids as each task's do, no more than one per id and buffer."""
    def contracted(table: pa.Table) -> pa.Table:
        both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks()
        coded = both.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[coded.indices.to_numpy()]
        label = roots(at[:len(table)], at[len(table):], len(order))
        node = np.flatnonzero(label != np.arange(len(label)))
        ids = coded.dictionary.take(pa.array(order))
        return pa.table([ids.take(pa.array(node)), ids.take(pa.array(label[node]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= LINKS:
                small = contracted(pa.Table.from_batches(held))
                if 2 * len(small) >= LINKS:
                    yield from small.to_batches()
                    held, size = [], 0
                else:
                    held, size = small.to_batches(), len(small)
        if size:
            yield from contracted(pa.Table.from_batches(held)).to_batches()

    return links.mapInArrow(run, links.schema)


def _stars(links: DataFrame) -> bool:
    """Whether every id stands in one link, or is the smaller end of all its links: each component is then done."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_id = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_id.where("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every id that has a link to another one; the component is its smallest id."""
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = written(_forest(links), "links")
    if links.count() <= LINKS:
        links = written(_forest(links.coalesce(1)), "links")                 # at most LINKS rows
    else:
        links = written(links.distinct(), "links")
        while not _stars(links):
            # Large star: larger neighbours of a node move to the least of its neighbourhood.
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # Small star: smaller neighbours of a node, and the node itself, move to the least of these.
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            links = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
