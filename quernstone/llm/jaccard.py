"""N-gram Jaccard join with grouped prefixes.

Documents are sets of distinct word shingles. Under one global order of shingles, rare ones first, two sets with Jaccard
similarity t or more share one of the first ``n - ceil(t * n) + 1`` shingles of either (its prefix).

1. *Order.* A sketch of fixed size counts all shingles of all documents; the order is by the sketch's rounded count, then by
   hash. Any order gives right results; this one keeps passages that many documents share out of prefixes.
2. *Groups.* Documents with identical prefix and size are one group; equal sets are one node of their group.
3. *Index.* Prefix shingles that occur once can join nothing: a fixed-size bitmap of those that occur twice or more
   thins the index before it is shuffled.
4. *Filter.* Group pairs from the index pass the size and the position filter, then their whole prefixes must share enough.
5. *Expand and verify.* Group pairs are expanded to pairs of their nodes, whose whole sets are intersected. First every group
   of an index list is paired with the list's pivot, the group with most shared prefix shingles. Lists whose
   groups are then in one component need nothing more; in the others all pairs of nodes in different components are
   verified, paired component by component. No link between components can be missed, and a list of near copies costs pairs in proportion to its length.

Defined results: null and empty texts have the empty set and are linked with nothing; texts with fewer words than a shingle
have their whole sequence as one; repeated rows are equal sets; a null id is never a component's smallest (unless it
is alone); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import repeated
from quernstone.llm.codepoints import mix
from quernstone.llm.components import connected_components
from quernstone.llm.staging import bounded_batches, discard, gathered, staged
from quernstone.llm.wordhash import shingle_sets

_CELL_BITS, _SEGMENTS = 20, 64
_SCAN = "kind int, doc_id {id}, node binary, grp long, n long, live int, tokens array<long>, places array<int>"


def _order_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Rounded logarithm of how often each of 2**20 cells of shingles occurs: 1 MB at any input size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << _CELL_BITS, np.int64)
        for _, unit in repeated.in_units(batches, 1):
            sets = list(shingle_sets(unit, width))
            cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - _CELL_BITS)).astype(np.int64), minlength=1 << _CELL_BITS)
        parts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(cells, _SEGMENTS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SEGMENTS, dtype=np.int32)), pa.array(parts, pa.binary())], ["segment", "cells"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in group.column("cells").to_pylist())
        level = np.rint(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"segment": group.column("segment")[:1], "cells": pa.array([level.tobytes()], pa.binary())})

    rows = gathered(texts.mapInArrow(count, "segment int, cells binary").groupBy("segment").applyInArrow(add, "segment int, cells binary"))
    size = (1 << _CELL_BITS) // _SEGMENTS
    out = np.zeros(1 << _CELL_BITS, np.uint8)
    for row in rows:
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.cells, np.uint8)
    return out


class _Prefixes:
    """Prefixes of shingle sets under the global order."""

    def __init__(self, order: np.ndarray, percent: int) -> None:
        self.order, self.percent = order, percent

    def of(self, members: np.ndarray) -> np.ndarray:
        n = len(members)
        length = n + (-self.percent * n // 100) + 1
        level = self.order[(members >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
        if length < n:  # members ascend, so a stable sort by level breaks ties by hash
            return members[np.argsort(level, kind="stable")[:length]]
        return members[np.argsort(level, kind="stable")]


def _group(prefix: np.ndarray, n: int) -> np.uint64:
    return mix(np.array([int(np.sum(mix(prefix + np.uint64(n)), dtype=np.uint64))], np.uint64))[0]


def _node(members: np.ndarray) -> bytes:
    """A set's name: equal sets are one node."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, members`` of the wanted nodes, each once. A fixed-size bitmap thins the scan, a semi-join makes it exact."""
    key = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long")
    shared = rows.sparkSession.sparkContext.broadcast(repeated.value_map(wanted.select(F.shiftleft(key, 4).alias("key")), "key"))  # 16 MB at any input size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in repeated.in_units(batches, 1):
            found = {_node(members): members for members in shingle_sets(unit, width) if len(members)}
            names = list(found)
            pick = repeated.passes(shared.value, np.array([int.from_bytes(x[:8], "big") for x in names], np.uint64)) if names else []
            take = [x for x, p in zip(names, pick, strict=True) if p]
            for k in range(0, len(take), 500):
                yield pa.RecordBatch.from_arrays([pa.array(take[k : k + 500], pa.binary()), pa.array([found[x].tobytes() for x in take[k : k + 500]], pa.binary())], ["node", "members"])

    return rows.mapInArrow(scan, "node binary, members binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def similar_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``. Ids are strings if those of ``docs`` are, or else longs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = "string" if docs.schema["doc_id"].dataType.simpleString() == "string" else "long"
    rows = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text")
    bits = repeated.bucket_bits(rows)
    order = spark.sparkContext.broadcast(_order_sketch(rows, width))  # 1 MB

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _Prefixes(order.value, percent)
        for _, unit in repeated.in_units(batches, 1):
            seen: dict[int, np.ndarray] = {}
            for members in shingle_sets(unit, width):
                if len(members):
                    prefix = prefixes.of(members)
                    seen[int(_group(prefix, len(members)))] = prefix
            yield repeated.blobs(np.concatenate([np.zeros(0, np.uint64), *seen.values()]), None, bits)

    shared = spark.sparkContext.broadcast(repeated.repeated_map(rows.mapInArrow(index, repeated.BLOBS), False, bits))  # 16 MB at any input size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _Prefixes(order.value, percent)
        names = [x.split()[0] for x in _SCAN.split(", ")]
        kinds = (pa.int32(), pa.string() if id_type == "string" else pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for batch, unit in repeated.in_units(batches, 1):
            out: list[tuple] = []
            groups: set[int] = set()
            for doc, members in zip(batch.column(0).to_pylist(), shingle_sets(unit, width), strict=True):
                n = len(members)
                if not n:
                    out.append((0, doc, None, None, 0, 0, None, None))
                    continue
                prefix = prefixes.of(members)
                node, group = _node(members), int(_group(prefix, n).astype(np.int64))
                place = np.flatnonzero(repeated.passes(shared.value, prefix))
                out.append((0, doc, node, group, n, len(place), None, None))
                if len(place) and group not in groups:
                    groups.add(group)
                    out.append((1, None, None, group, n, len(place), prefix[place].astype(np.int64), place.astype(np.int32)))
            for k in range(0, len(out), 2000):
                columns = zip(*out[k : k + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)
    scanned = staged(rows.mapInArrow(scan, _SCAN.format(id=id_type)), "shingled")
    own = staged(scanned.where("kind = 0").select("doc_id", "node", "n"), "own")
    listed = scanned.where("kind = 1").select("grp", "n", (F.col("live") / F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).alias("common"), F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    listed = listed.select(F.col("t.tokens").alias("token"), F.struct((-F.col("common")).alias("rank"), "grp", "n", F.col("t.places").alias("place")).alias("g"))
    # An index list counts if it has two groups; its pivot is the group with most shared prefix shingles.
    heads = listed.groupBy("token").agg(F.min("g").alias("pivot"), F.min("g.grp").alias("least"), F.max("g.grp").alias("most")).where("least < most").select("token", "pivot")
    # All that grows with the table is joined by merging at every size, so that plan and shuffle grow in proportion.
    lists = staged(listed.join(heads.hint("merge"), "token").select("token", "pivot", "g").distinct(), "lists")
    prefixes = staged(scanned.where("kind = 1").select("grp", "n", "tokens"), "prefixes")
    every = scanned.where("kind = 0 and node is not null").select("grp", "node").distinct()
    several = every.groupBy("grp").count().where("count > 1").select("grp")
    joined = lists.select(F.col("g.grp").alias("grp")).union(several).distinct()
    nodes = staged(every.join(joined, "grp", "left_semi"), "nodes")
    several = staged(several, "several")
    discard(scanned, spark)

    def fits(x: str, y: str) -> str:
        """The size filter, and the position filter as it holds for the first shared shingle."""
        overlap = f"ceil(({x}.n + {y}.n) * {percent} / (100 + {percent}) - 1e-6)"
        return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND least({x}.n - {x}.place, {y}.n - {y}.place) >= {overlap}"

    def sharing(pairs: DataFrame) -> DataFrame:
        """Group pairs ``(ga, gb)`` whose prefixes share enough.

        Of two prefixes that end at different shingles of the order, what the sets share beyond both prefixes' common shingles
        lies behind the end of the one that ends first.
        """
        wanted = pairs.select(F.explode(F.array("ga", "gb")).alias("grp")).distinct()
        held = staged(prefixes.join(wanted.hint("merge"), "grp", "left_semi").dropDuplicates(["grp"]), "pair-prefixes")
        side = lambda k: held.select(F.col("grp").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")).hint("merge")
        behind = f"greatest(ceil(na * {percent} / 100 - 1e-6), ceil(nb * {percent} / 100 - 1e-6)) - 1"
        enough = f"ga = gb OR size(array_intersect(ta, tb)) + {behind} >= ceil((na + nb) * {percent} / (100 + {percent}) - 1e-6)"
        out = staged(pairs.join(side("a"), "ga").join(side("b"), "gb").where(enough).select("ga", "gb"), "sharing")
        discard(held, spark)
        return out

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets are similar; the sets of nodes in pairs are made from their texts anew."""
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            return pairs

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        sets = staged(_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width), "sets")
        a = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
        b = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
        edges = staged(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a binary, b binary"), "edges")
        for done in (sets, pairs):
            discard(done, spark)
        return edges

    stars = lists.select("pivot", "g").where("pivot.grp <> g.grp").where(fits("pivot", "g")).select(F.col("pivot.grp").alias("ga"), F.col("g.grp").alias("gb")).distinct()
    stars = sharing(staged(stars, "stars"))
    inside = several.select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    first = nodes.groupBy(F.col("grp").alias("ga")).agg(F.min("node").alias("a"))
    members = nodes.select(F.col("grp").alias("gb"), F.col("node").alias("b"))
    edges = verify(both_ways(stars.unionByName(inside).join(first.hint("merge"), "ga").join(members.hint("merge"), "gb")))

    labels = staged(connected_components(edges), "labels")
    labelled = staged(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    # What is left to compare: nodes of one list, or of one group, in different components.
    listed = lists.select(F.struct("token", F.lit(0).cast("long").alias("same")).alias("list"), F.col("g.grp").alias("grp"), F.col("g.n").alias("n"), F.col("g.place").alias("place"))
    listed = listed.unionByName(several.select(F.struct(F.lit(0).cast("long").alias("token"), F.col("grp").alias("same")).alias("list"), "grp", F.lit(1).cast("long").alias("n"), F.lit(0).alias("place")))
    left = listed.join(labelled.hint("merge"), "grp").select("list", "grp", "node", "label", "n", "place")
    mixed = left.groupBy("list").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("list")
    left = staged(left.join(mixed.hint("merge"), "list"), "open-lists")
    for done in (nodes, several, lists, labelled):
        discard(done, spark)
    # Components are paired first, so that members of one component never meet, however many a list has. Members of the larger
    # one must fit the bounds of the smaller one before they are paired with its members.
    rest = F.col("n") - F.col("place")
    heads = left.groupBy("list", "label").agg(F.struct(F.count(F.lit(1)).alias("m"), "label").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(rest).alias("rest"))

    def may_fit(x_low: str, x_high: str, x_rest: str) -> str:
        return f"100 * {x_high} >= {percent} * q.low AND 100 * q.high >= {percent} * {x_low} AND least({x_rest}, q.rest) >= ceil(({x_low} + q.low) * {percent} / (100 + {percent}) - 1e-6)"

    met = heads.alias("p").join(heads.alias("q").hint("merge"), F.expr(f"p.list = q.list AND p.size > q.size AND {may_fit('p.low', 'p.high', 'p.rest')}"))
    met = met.select(F.col("p.list").alias("list"), F.col("p.label").alias("label"), F.struct("q.label", "q.low", "q.high", "q.rest").alias("q"))
    x = left.select("list", "label", F.struct("grp", "node", "n", "place").alias("x")).alias("l")
    y = left.select("list", "label", F.struct("grp", "node", "n", "place").alias("y")).alias("r")
    met = met.alias("m").join(x.hint("merge"), F.expr(f"m.list = l.list AND m.label = l.label AND {may_fit('x.n', 'x.n', 'x.n - x.place')}")).select("m.list", "q", "x")
    met = met.alias("m").join(y.hint("merge"), F.expr(f"m.list = r.list AND q.label = r.label AND {fits('x', 'y')}"))
    met = met.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb"), F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    met = staged(met.distinct(), "met")
    kept = sharing(met.select("ga", "gb").distinct())
    more = verify(both_ways(met.join(kept.hint("merge"), ["ga", "gb"], "left_semi")))
    if not more.isEmpty():
        labels = staged(connected_components(edges.unionByName(more)), "labels")
    for done in (left, edges, more, met, prefixes, stars):
        discard(done, spark)

    member = own.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = member.where("node is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return member.join(least.hint("merge"), "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS m FROM r GROUP BY doc_id) USING (doc_id)"""
