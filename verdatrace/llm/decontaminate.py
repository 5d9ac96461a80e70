"""Benchmark decontamination over a distributed positional inverted index.

:func:`build_index` turns documents into *segments*: one row for some thousand
documents with, for every term of the segment, the ascending positions of its
tokens.  The segments are stored as Parquet in the shared folder; they are the
index, and any number of benchmarks can be looked up in it without the texts.
A window is looked up only in segments that have its rarest term: the terms of
the test items are counted over the whole index first, each window is filed under
the one that is rarest there, and a segment walks its own terms.  From that
term's list on the offset-adjusted lists are intersected, the rarest of the
segment first, until one is empty: with a tolerance for proximity matches (every
word at most ``SLOP`` words beside its place), exactly for phrases.  Segments hold
whole documents, so no lookup crosses tasks and nothing is shuffled; one frequent
term, document or passage only lengthens lists inside segments.

Test items are sent to the executors in blocks of at most ``BLOCK_WINDOWS``
windows, so what is broadcast at once has a fixed bound; each further block is
one more pass over the stored index.

Nulls, empties and the rest: a null or wordless text has no words, no hits and
is not contaminated; an item without words matches nothing; an item with a null
id hits words like any other but has no id to be counted or listed; rows with
null or repeated ids are reported one by one; items that share an id count once;
a text longer than a segment is a segment of its own; of equally rare terms the
first of the alphabet leads; columns beside key and text are neither read nor returned,
but :func:`keep_clean` returns them as they are; empty tables on either side
give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import bytes_of, chunks, identity, map_arrow, settle, without_rows

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Words by which a word may lie beside its place in a proximity match.
SLOP = 2
#: Bytes of text that a segment covers, one document at least.
SEGMENT_BYTES = 4 << 20
#: Windows of test items that are broadcast at once.
BLOCK_WINDOWS = 200_000

#: Every byte that is no part of a word becomes a space, A-Z become a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))

_INDEX = "n_words array<int>, terms array<binary>, counts array<int>, positions binary"


def words(text: bytes) -> list[bytes]:
    """Words of a text: lower-case ASCII letters, digits and everything beyond ASCII."""
    return text.translate(_TABLE).split()


def _segment(texts: list[bytes]) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """Words of each text, terms in order, tokens of each term, and their positions term by term, each list as differences."""
    codes: dict[bytes, int] = {}
    lengths, tokens = [], []
    for text in texts:
        found = words(text)
        lengths.append(len(found))
        tokens.append(np.fromiter((codes.setdefault(w, len(codes)) for w in found), np.int32, len(found)))
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    terms = sorted(codes)
    rank = np.empty(len(terms), np.int32)
    rank[[codes[t] for t in terms]] = np.arange(len(terms), dtype=np.int32)
    token = rank[token] if len(terms) else token
    order = np.argsort(token, kind="stable").astype(np.uint32)
    counts = np.bincount(token, minlength=len(terms)).astype(np.int32)
    gaps = np.diff(order, prepend=np.uint32(0))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
    gaps[starts] = order[starts]
    return lengths, terms, counts, gaps


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the positional index of all words of all documents; returns the stored segments.

    Columns: ``keys`` (the documents' keys), ``n_words``, ``terms`` (ascending),
    ``counts`` and ``positions`` (unsigned 32-bit differences, term by term; a
    position counts words from the start of the segment).
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = bytes_of(batch.column(1))
        for start, end in chunks(texts, SEGMENT_BYTES):
            lengths, terms, counts, gaps = _segment(texts[start:end])
            keys = batch.column(0).slice(start, end - start)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([terms], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int32())), pa.array([gaps.tobytes()], pa.binary())],
                names=["keys", "n_words", "terms", "counts", "positions"],
            )

    return settle(map_arrow(docs.select(key, text), run, f"keys array<{kind}>, {_INDEX}"), "postings")[0]


def _numbers(terms: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms asked for are among a segment's terms: their numbers, and their places there."""
    number = pc.index_in(terms, value_set=asked).fill_null(-1).to_numpy()
    place = np.flatnonzero(number >= 0)
    return number[place], place


class _Postings:
    """Posting lists of one stored segment, for the terms in ``asked``."""

    def __init__(self, terms: pa.Array, counts: np.ndarray, gaps: bytes, n_words: np.ndarray, asked: pa.Array):
        #: From the number that a term has among those asked for to its place here.
        self.place = dict(zip(*(x.tolist() for x in _numbers(terms, asked)), strict=True))
        self.ends = np.cumsum(counts)
        self.counts = counts
        self.gaps = np.frombuffer(gaps, "<u4")
        self.doc_ends = np.cumsum(n_words)
        self.doc_starts = self.doc_ends - n_words
        self.lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            end = self.ends[term]
            self.lists[term] = np.cumsum(self.gaps[end - self.counts[term] : end], dtype=np.int64)
        return self.lists[term]

    def matches(self, window: list[int], first: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the exact phrase, and positions of its word number ``first`` with every other at most ``slop`` words beside its place.

        Both lie within documents; every exact match is a proximity match, so the
        intersection with tolerance comes first and narrows the exact one.
        """
        none = np.zeros(0, np.int64)
        terms = [self.place.get(t) for t in window]
        if None in terms:
            return none, none
        order = sorted((k for k in range(len(terms)) if k != first), key=lambda k: self.counts[terms[k]])
        anchor = self.positions(terms[first])
        doc = self.document(anchor)
        low, high = self.doc_starts[doc], self.doc_ends[doc] - 1
        for k in order:
            at = self.positions(terms[k])
            place = anchor + (k - first)
            # The first occurrence within the tolerance and the document, if there is one.
            found = np.searchsorted(at, np.maximum(place - slop, low))
            ok = (found < len(at)) & (at[np.minimum(found, len(at) - 1)] <= np.minimum(place + slop, high))
            if not ok.any():
                return none, none
            if not ok.all():
                anchor, low, high = anchor[ok], low[ok], high[ok]
        starts = anchor - first
        starts = starts[(starts >= low) & (starts + len(terms) - 1 <= high)]
        for k in order:
            if not len(starts):
                break
            at = self.positions(terms[k])
            starts = starts[at[np.minimum(np.searchsorted(at, starts + k), len(at) - 1)] == starts + k]
        return starts, anchor

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, positions, side="right")


def windows_of(items: list[tuple], width: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """From each distinct window to the ids (null for none) of the items that have it."""
    out: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        w = words((text or "").encode())
        for k in range(max(1, len(w) - width + 1) if w else 0):
            owners = out.setdefault(tuple(w[k : k + width]), [])
            if item not in owners:
                owners.append(item)
    return out


def _blocks(items: DataFrame, key: str, text: str, width: int) -> Iterator[dict[tuple[bytes, ...], list]]:
    """Windows of the items, in blocks of bounded size, one item at least; items arrive one partition at a time."""
    rows, size = [], 0
    for row in items.select(F.col(key).cast("string").alias("_item"), F.col(text).alias("_text")).toLocalIterator():
        rows.append((row["_item"], row["_text"]))
        size += len(row["_text"] or "") // 4 + 1  # words, roughly
        if size >= BLOCK_WINDOWS:
            yield windows_of(rows, width)
            rows, size = [], 0
    yield windows_of(rows, width)


def _filed(index: DataFrame, block: dict[tuple[bytes, ...], list]) -> tuple[list[bytes], dict[int, list]]:
    """The block's terms, which are numbered in order, and the windows (as numbers, with their owners) under the term that is rarest in the index."""
    terms = sorted({t for w in block for t in w})
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(segments: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, total = pa.array(shared.value, pa.binary()), np.zeros(len(shared.value), np.int64)
        for k in range(segments.num_rows):
            number, place = _numbers(segments.column(0)[k].values, asked)
            total[number] += np.asarray(segments.column(1)[k].values)[place]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "n"])

    counted = {r["term"]: r["n"] for r in map_arrow(index.select("terms", "counts"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    number_of = {t: k for k, t in enumerate(terms)}
    filed: dict[int, list] = {}
    for w, owners in block.items():
        numbers = [number_of[t] for t in w]
        if all(t in counted for t in numbers):  # a term that no document has
            rarest = min(numbers, key=lambda t: (counted[t], t))
            filed.setdefault(rarest, []).append((numbers, numbers.index(rarest), owners))
    return terms, filed


def phrase_matches(index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row a document: ``key``, ``n_words``, ``spans``, ``items``, ``near`` and ``near_items``.

    ``spans`` has the first and last word (counted from 0) of each exact match,
    ``near`` the word of a proximity match's rarest term, in order; ``items`` and
    ``near_items`` are the matching items' ids as text, ascending.
    """
    sc, frames = index.sparkSession.sparkContext, []
    kind = index.schema["keys"].dataType.elementType.simpleString()
    schema = f"segment bigint, place bigint, key {kind}, n_words bigint, spans array<struct<first: int, last: int>>, items array<string>, near array<int>, near_items array<string>"
    # Segment and place tell documents of equal or null keys apart when blocks are put together.
    rows = index.select("keys", "n_words", "terms", "counts", "positions", F.monotonically_increasing_id().alias("segment"))
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for block in _blocks(items, item_key, item_text, width):
        shared = sc.broadcast(_filed(index, block))

        def run(segments: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            asked, filed = pa.array(shared.value[0], pa.binary()), shared.value[1]
            for k in range(segments.num_rows):
                column = {n: segments.column(i)[k] for i, n in enumerate(segments.schema.names)}
                keys, lengths = column["keys"].values, np.asarray(column["n_words"].values, np.int64)
                postings = _Postings(column["terms"].values, np.asarray(column["counts"].values, np.int32), column["positions"].as_py(), lengths, asked)
                size = range(len(keys))
                spans, near = [set() for _ in size], [set() for _ in size]
                found, near_found = [set() for _ in size], [set() for _ in size]
                for term in postings.place:
                    for window, rarest, owners in filed.get(term, ()):
                        starts, anchors = postings.matches(window, rarest, slop)
                        for at, doc in zip(starts.tolist(), postings.document(starts).tolist(), strict=True):
                            first = at - int(postings.doc_starts[doc])
                            spans[doc].add((first, first + len(window) - 1))
                            found[doc].update(owners)
                        for at, doc in zip(anchors.tolist(), postings.document(anchors).tolist(), strict=True):
                            near[doc].add(at - int(postings.doc_starts[doc]))
                            near_found[doc].update(owners)
                listed = lambda x: pa.array([sorted(i for i in ids if i is not None) for ids in x], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), column["segment"].as_py(), np.int64)), pa.array(np.arange(len(keys), dtype=np.int64)), keys, pa.array(lengths, pa.int64()),
                        pa.array([[{"first": a, "last": b} for a, b in sorted(x)] for x in spans], span), listed(found), pa.array([sorted(x) for x in near], pa.list_(pa.int32())), listed(near_found),
                    ],
                    names=["segment", "place", "key", "n_words", "spans", "items", "near", "near_items"],
                )

        frames.append(map_arrow(rows, run, schema))
    whole = frames[0]
    if len(frames) > 1:
        for frame in frames[1:]:
            whole = whole.unionAll(frame)
        whole = whole.groupBy("segment", "place").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "items", "near", "near_items")))
    return whole.drop("segment", "place")


def covered(spans: str) -> F.Column:
    """Words inside any of the spans, which are in order."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, a["end"]))).alias("n"), F.greatest(a["end"], s["last"]).alias("end")),
        lambda a: a["n"].cast("bigint"),
    )


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``n_near_items`` (items with proximity matches)."""
    found = phrase_matches(build_index(docs, key, text), items, item_key, item_text)
    return found.select(
        F.col("key").alias(key),
        "n_words",
        covered("spans").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item, whatever their keys."""
    rows = docs.select(identity(key, text).alias("own"), F.col(text).alias("t"))
    index = build_index(rows, "own", "t")
    found, total = phrase_matches(index, items), index.agg(F.sum(F.size("keys"))).first()[0] or 0
    return without_rows(docs, key, text, found.where(F.size("spans") > 0).select("key"), total)
