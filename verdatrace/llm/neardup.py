"""SimHash near-duplicates by sharded vantage-point trees.

A text's fingerprint has 64 bits, the majorities over the XXH64 hashes of its
word shingles.  Distinct fingerprints are nodes; two nodes link if at most
``RADIUS`` bits differ, and documents are grouped by connected components.

The upper levels of a vantage-point tree are fitted to a bounded sample of
fingerprints.  They cut the space into shards; a shard that is still large is
cut again, by a tree fitted to a sample of its own, until all are small, so a
shard's size does not grow with the input.  At a vantage point with median
distance ``mu`` a fingerprint belongs inside (at most ``mu``) or outside.  By
the triangle inequality only a fingerprint whose distance is within the radius
of ``mu`` can have links across, so such fingerprints are copied over the
boundary; of each crossing pair the outer one is copied inwards.  Each shard
then grows its own tree, prunes by the same bounds and compares what is left
exactly.  A shard gives a spanning forest of its links, not its pairs, so a
dense group costs rows in proportion to its size.  The forests of all shards
are put together by distributed connected components.

Exact copies share a fingerprint and are one node, whatever their number.  A
shard stays large only where cutting it no longer makes it smaller (hundreds of
thousands of different fingerprints within a few bits of each other); it is
searched in one task, as exactly.

Nulls, empties and the rest: null and wordless texts have the fingerprint zero
and link like any other; a null key never becomes a component's name unless all
its members' keys are null; repeated rows are reported one by one; very long
texts take steps of bounded memory; ties (equal fingerprints) are links at
distance zero; columns beside key and text are neither read nor returned, but
:func:`keep_first` returns them as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import bytes_of, drop_path, gathered, identity, join_keyed, map_arrow, once, settle, without_rows
from verdatrace.llm.graph import components

#: Differing bits up to which fingerprints link.
RADIUS = 2
#: Words of a shingle.
SHINGLE = 3
#: Fingerprints that a shard is meant to hold.
SHARD_NODES = 2500
#: Shards with more than LARGE * SHARD_NODES fingerprints are cut again.
LARGE = 25
#: Fingerprints that the upper levels are fitted to, about.
SAMPLE = 8192
#: Levels that are cut at a time.
LEVELS = 8
#: Trees that are broadcast at a time, of 2 ** LEVELS nodes at most.
TREES = 1024
#: Names of shards up to which a list of them is broadcast; they are counted first.
HOT_SHARDS = 500_000
#: Fingerprints below which a shard's tree compares all.
_LEAF = 192
_BITS = 1 << 22

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """Fingerprint of a text, unsigned; zero without words."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)  # one shingle: its bits are the majority
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):  # long texts in steps of bounded memory
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = np.array([simhash(x) for x in bytes_of(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[key, "fp"])

    return map_arrow(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, fp bigint")


# -- vantage-point trees ----------------------------------------------------


def _distance(fp: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fp ^ point)


def _vantage(fp: np.ndarray) -> tuple[np.uint64, int] | None:
    """A point and the distance that halves ``fp`` best, of a few tries; None if nothing can be halved."""
    best = None
    for k in np.linspace(0, len(fp) - 1, 7).astype(int):
        d = np.sort(_distance(fp, fp[k]))
        mu = int(d[(len(d) - 1) // 2])
        inside, across = int(np.searchsorted(d, mu, "right")), int(np.searchsorted(d, mu + RADIUS, "right") - np.searchsorted(d, mu - RADIUS, "right"))
        cost = max(inside, len(fp) - inside) + across
        if inside < len(fp) and (best is None or cost < best[0]):
            best = (cost, fp[k], mu)
    return best and best[1:]


def upper_tree(sample: np.ndarray, depth: int) -> list:
    """Nodes ``(point, mu, inner, outer)``; children are node numbers, or shards as ``-1 - shard``."""
    nodes: list = []
    shards = 0

    def grow(fp: np.ndarray, level: int) -> int:
        nonlocal shards
        found = _vantage(fp) if level and len(fp) > 8 else None
        if found is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        inside = _distance(fp, found[0]) <= found[1]
        nodes[at] = (*found, grow(fp[inside], level - 1), grow(fp[~inside], level - 1))
        return at

    grow(sample, depth)
    return nodes


def route(fp: np.ndarray, tree: list, resident: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, fingerprints, resident)``: each resident fingerprint as resident of one shard, and as copy where its links may reach."""
    resident = np.ones(len(fp), bool) if resident is None else resident
    if not tree:
        yield 0, fp, resident
        return
    work = [(0, fp, resident)]
    while work:
        at, x, resident = work.pop()
        point, mu, inner, outer = tree[at]
        d = _distance(x, point).astype(np.int16)
        inside = d <= mu
        # Inwards goes what is inside, and whatever may link inside; outwards only copies need to cross.
        for child, go, home in ((inner, d <= mu + RADIUS, inside), (outer, ~inside | (~resident & (d > mu - RADIUS)), ~inside)):
            if go.any():
                part = (child, x[go], (resident & home)[go])
                if child >= 0:
                    work.append(part)
                else:
                    yield -1 - child, part[1], part[2]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked entries the least label of theirs, in place."""
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def forest(fp: np.ndarray, resident: np.ndarray) -> np.ndarray:
    """Index of each fingerprint's root, by the links that have a resident at one end at least."""
    label = np.arange(len(fp))
    work = [(np.flatnonzero(resident), np.arange(len(fp)))]
    while work:
        own, asked = work.pop()
        found = _vantage(fp[own]) if len(own) > _LEAF else None
        if found is None:
            step = max(1, _BITS // max(1, len(own)))
            for k in range(0, len(asked), step):
                rows, columns = np.nonzero(np.bitwise_count(fp[asked[k : k + step], None] ^ fp[own]) <= RADIUS)
                _merge(label, asked[k + rows], own[columns])
            continue
        point, mu = found
        d_own, d = _distance(fp[own], point), _distance(fp[asked], point).astype(np.int16)
        work.append((own[d_own <= mu], asked[d <= mu + RADIUS]))
        work.append((own[d_own > mu], asked[d > mu - RADIUS]))
    return label


def _packed(tree: list) -> bytes:
    """Nodes of a tree as rows of four 64-bit integers."""
    return np.array([(int(np.uint64(p).view(np.int64)), mu, inner, outer) for p, mu, inner, outer in tree], "<i8").tobytes()


def _unpacked(data: bytes) -> list:
    return [] if not data else [(np.int64(p).view(np.uint64), int(mu), int(inner), int(outer)) for p, mu, inner, outer in np.frombuffer(data, "<i8").reshape(-1, 4)]


_SHARDED = "shard bigint, fp bigint, resident boolean, above bigint"


def _cut(rows: DataFrame, large: DataFrame, count: int) -> DataFrame:
    """``rows`` of the ``count`` shards in ``large`` (``shard``, ``n``), dealt to smaller shards by a tree for each."""
    near = F.broadcast(large) if count <= TREES else large
    # About SAMPLE rows of each shard, chosen by a hash of the fingerprint.
    picked = rows.join(near, "shard").where(F.pmod(F.xxhash64("fp", "shard"), F.lit(1 << 30)).cast("double") * F.col("n") <= float(SAMPLE << 30)).select("shard", "fp", "n")

    def fit(table: pa.Table) -> pa.Table:
        fp = np.sort(np.ascontiguousarray(table.column("fp").to_numpy()).view(np.uint64))
        n = table.column("n")[0].as_py()
        tree = upper_tree(fp, min(LEVELS, max(1, math.ceil(math.log2(max(2, n) / SHARD_NODES)))))
        return pa.table({"shard": table.column("shard")[:1], "n": table.column("n")[:1], "tree": pa.array([_packed(tree)], pa.binary())})

    trees = picked.groupBy("shard").applyInArrow(fit, "shard bigint, n bigint, tree binary")
    blocks, out = -(-count // TREES), []
    trees = settle(trees, "trees")[0] if blocks > 1 else trees
    for block in range(blocks):
        held = {r["shard"]: (r["n"], r["tree"]) for r in trees.where(F.pmod(F.xxhash64("shard"), F.lit(blocks)) == block).collect()}
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def deal(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            shard, fp, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for of in np.unique(shard):
                if int(of) not in shared.value:
                    continue
                n, tree = shared.value[int(of)]
                own = shard == of
                for leaf, x, resident in route(np.ascontiguousarray(fp[own]).view(np.uint64), _unpacked(tree), home[own]):
                    # A shard's name is a hash; should two ever share one, they are searched together, which loses nothing.
                    name = (int(of) * 0x9E3779B97F4A7C15 + (leaf + 1) * 0xC2B2AE3D27D4EB4F) % (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), name, np.int64)), pa.array(x.view(np.int64)), pa.array(resident), pa.array(np.full(len(x), n, np.int64))], names=["shard", "fp", "resident", "above"])

        out.append(map_arrow(rows.select("shard", "fp", "resident"), deal, _SHARDED))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionAll(part)
    return whole


def shards(nodes: DataFrame, count: int) -> DataFrame:
    """All fingerprints dealt to shards, with copies where links may reach: ``shard``, ``fp``, ``resident``."""
    rows = nodes.select(F.lit(0).cast("bigint").alias("shard"), "fp", F.lit(True).alias("resident"))
    if count <= SHARD_NODES:
        return rows
    rows, done = settle(_cut(rows, rows.sparkSession.range(1).select(F.col("id").alias("shard"), F.lit(count).cast("bigint").alias("n")), 1), "shards")[0], []
    while True:
        # A shard that cutting has not made smaller by a fifth stays as it is.
        large = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("above").alias("above")).where((F.col("n") > LARGE * SHARD_NODES) & (5 * F.col("n") < 4 * F.col("above"))).select("shard", "n")
        large, _ = settle(large, "large")
        if not (size := large.count()):
            break
        side = F.broadcast(large.select("shard")) if size <= HOT_SHARDS else large.select("shard")
        done.append(rows.join(side, "shard", "left_anti"))
        rows, _ = settle(_cut(rows.join(side, "shard", "left_semi"), large, size), "shards")
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("shard", "fp", "resident")


def links(nodes: DataFrame, count: int) -> DataFrame:
    """Spanning forests of the links between the distinct fingerprints ``fp``: edges ``u``, ``v``."""

    def search(table: pa.Table) -> pa.Table:
        fp = np.ascontiguousarray(table.column("fp").to_numpy()).view(np.uint64)
        root = forest(fp, table.column("resident").to_numpy())
        out = root != np.arange(len(root))
        return pa.table({"u": fp[out].view(np.int64), "v": fp[root[out]].view(np.int64)})

    return shards(nodes, count).groupBy("shard").applyInArrow(search, "u bigint, v bigint")


# -- classes ----------------------------------------------------------------


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document: ``own`` (its identity), ``fp``, and ``first``, the identity of its component's first document."""
    spark = docs.sparkSession
    rows = docs.select(identity(key, text).alias("own"), F.col(text).alias("t"))
    prints, _ = settle(fingerprints(rows, "own", "t"), "prints")
    # The least key is first; where all are null, the least hash.
    total = prints.count()
    nodes, _ = settle(gathered(prints.groupBy("fp").agg(F.min(F.struct(F.col("own.key").isNull().alias("none"), "own")).alias("first")), total), "nodes")
    count = nodes.count()
    edges, path = settle(links(nodes, count), "links")
    joined = components(edges)
    drop_path(spark, path)
    # A root has no row of its own in `joined`; it names itself.
    members = joined.unionAll(joined.select(F.col("root").alias("node"), "root").distinct())
    named, _ = settle(gathered(members.join(nodes, members["node"] == nodes["fp"]).select("node", "root", "first"), count), "members")
    named = join_keyed(named.drop("first"), named.groupBy("root").agg(F.min("first").alias("name")), "root", total=count)
    of_node = nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", F.coalesce("name", "first").alias("name"))
    # A third of all documents may share a fingerprint.
    return gathered(join_keyed(prints, of_node, "fp", total=total, plain=0).select("own", "fp", F.col("name.own").alias("first")), total)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``key``, ``fp`` and ``component_id``, the least key that links reach."""
    return _classes(docs, key, text).select(F.col("own.key").alias(key), "fp", F.col("first.key").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least key, null keys last.

    Rows are told apart by key and text, so rows with null or repeated keys are
    dropped like any other; of rows that repeat both one stays.
    """
    found, _ = settle(_classes(docs, key, text).select("own", "first"), "classes")
    total = found.count()
    kept = without_rows(docs, key, text, found.where(~F.col("own").eqNullSafe(F.col("first"))).select("own"), total)
    return once(kept, key, text, found.where(F.col("own").eqNullSafe(F.col("first"))).groupBy("own").count().where("count > 1").select("own"), total)
