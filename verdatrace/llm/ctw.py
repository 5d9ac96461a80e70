"""Language-model scoring by context-tree weighting over bytes.

Each byte is decomposed into eight binary decisions.  For every partial byte
there is a tree over the preceding bytes, ``DEPTH`` deep; its nodes hold
Krichevsky-Trofimov estimates from the training texts, and a node's estimate is
weighted against the product of its children's by their block probabilities, so
a prediction mixes the estimates of all depths.  A text's score is the log10
probability of its lower-cased bytes and its end; :func:`score` also gives the
code length in bits per byte.

Counts cover all training texts, and every n-gram of them is kept.  The tree is
never in one place: n-grams are dealt to buckets by their last two context
bytes, so a bucket holds whole subtrees from depth two on, and builds them when
it is asked.  Only the two upper levels, 65,536 contexts and partial bytes at
most, are put together on the driver from sums over the buckets.

Beside it stands a unigram word model with additive smoothing; words are told
apart by their XXH64 and dealt to buckets by it.

A text's n-grams and words are looked up in two ways with one result: those with
at least a ``2 ** HOT_BITS``-th of all (fewer than ``2 ** HOT_BITS`` of each) are
broadcast with their values as sorted hash arrays, and all others go to their
buckets as packed requests, which come back as sums by document.  So scores do
not depend on where that line is drawn.

Nulls, empties and the rest: a null text is the empty text, which has one token
(its end); a null id is not held out and is learned from; repeated rows count
and are scored each; a text longer than a segment is a segment of its own;
columns beside key and text are neither read nor returned; ties do not arise; an
empty table gives an empty table, and with nothing to learn from every byte
costs eight bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import bytes_of, chunks, map_arrow, settle
from verdatrace.llm.ngrams import PACKED, Counts, HashArray, bucket_count, bucket_of, packed, sum_buckets, total, windows
from verdatrace.llm.quality import held_out

#: Preceding bytes that a prediction looks at; two at least.
DEPTH = 5
#: A word or an n-gram is broadcast with a 2 ** HOT_BITS-th of all.
HOT_BITS = 22
#: Bytes of text of a segment, whose lookups travel together.
SEGMENT_BYTES = 4 << 20
#: Rows of a batch, and bytes of text, that counting turns into arrays at a time; distinct words that it holds.
SLICE_ROWS, COUNTED_BYTES, HELD_WORDS = 1_000, 1 << 20, 200_000
#: The token that ends every text; no word has white space.
END = b"\n"

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORDS, _NGRAMS = 0, 1


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


# -- the model --------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument up by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _node(code: np.ndarray, k: int) -> np.ndarray:
    """Node of the k-th decision: the context and, in the lowest byte, the bits decided so far under a leading one."""
    return (code & ~np.uint64(255)) | np.uint64(1 << k) | ((code & np.uint64(255)) >> np.uint64(8 - k))


def _bit(code: np.ndarray, k: int) -> np.ndarray:
    return ((code >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)


def _shorter(code: np.ndarray, depth: int) -> np.ndarray:
    """The n-gram, or node, with ``depth`` context bytes."""
    return code & np.uint64((1 << (8 * depth + 8)) - 1)


def _level(own_counts: tuple[np.ndarray, np.ndarray], below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate of a one, weight of the own estimate against the children's, and log of the weighted block, node by node.

    ``below`` is the sum of the children's weighted blocks; a training n-gram
    has all its context, so an inner node's children cover all that it counts.
    """
    n0, n1 = (x.astype(float) for x in own_counts)
    own = _block(n0, n1)
    if below is None:
        return (n1 + 0.5) / (n0 + n1 + 1), np.ones(len(n0)), own
    mixed = np.logaddexp(own, below) - np.log(2)
    return (n1 + 0.5) / (n0 + n1 + 1), np.exp(own - np.log(2) - mixed), mixed


class Subtree:
    """Nodes from depth ``top`` down to ``depth`` over all training n-grams that share their first ``top`` context bytes with one of these."""

    def __init__(self, code: np.ndarray, count: np.ndarray, depth: int, top: int = 2):
        """``code``: distinct (depth + 1)-grams in ascending order, newest byte lowest."""
        self.depth, self.top = depth, top
        #: By depth and decision: node keys in ascending order, estimates, weights.
        self.levels: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: By decision: node keys at ``top``, their counts, logs of their weighted blocks.
        self.roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        below: list = [None] * 8
        for d in range(depth, top - 1, -1):
            if d < depth:
                code, count = total(_shorter(code, d), count)
            self.roots = []
            for k in range(8):
                # The n-grams ascend, and with them their nodes.
                node = _node(code, k)
                first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
                key, bit = node[first], _bit(code, k)
                n1, n0 = (np.add.reduceat(np.where(x, count, 0), first) if len(first) else np.zeros(0) for x in (bit, ~bit))
                under = None
                if below[k] is not None:
                    child, log = below[k]
                    under = np.bincount(np.searchsorted(key, _shorter(child, d)), log, len(key))
                estimate, weight, log = _level((n0, n1), under)
                self.levels[d, k] = (key, estimate, weight)
                below[k] = (key, log)
                self.roots.append((key, n0, n1, log))

    def one(self, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one at the k-th decision as depth ``top`` and all below see it, and whether they ever saw the node."""
        p, found = np.full(len(node), 0.5), np.zeros(len(node), bool)
        for d in range(self.depth, self.top - 1, -1):
            key, estimate, weight = self.levels[d, k]
            if not len(key):
                continue
            asked = _shorter(node, d)
            place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            ok = key[place] == asked
            w, own = weight[place[ok]], estimate[place[ok]]
            # Below the deepest node that was ever seen there is nothing to weigh against.
            p[ok] = np.where(found[ok], w * own + (1 - w) * p[ok], own)
            found |= ok
        return p, found


class Upper:
    """The levels of no and of one context byte, as dense tables."""

    def __init__(self, nodes: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        """Nodes of one context byte, their counts, and the sums of their children's weighted blocks."""
        estimate, weight, log = _level((n0, n1), below)
        self.levels = [(np.full(1 << 8, 0.5), np.ones(1 << 8), np.zeros(1 << 8, bool)), (np.full(1 << 16, 0.5), np.ones(1 << 16), np.zeros(1 << 16, bool))]
        root = (nodes & np.uint64(255)).astype(np.int64)
        seen = np.unique(root)
        tables = [(seen, *_level(tuple(np.bincount(root, x, 256)[seen] for x in (n0, n1)), np.bincount(root, log, 256)[seen])[:2]), (nodes.astype(np.int64), estimate, weight)]
        for (p, w, known), (at, own, of) in zip(self.levels, tables, strict=True):
            p[at], w[at], known[at] = own, of, True

    def log10(self, code: np.ndarray, deep: Subtree) -> np.ndarray:
        """Log10 probability of the last byte of each n-gram after the others; ``deep`` has the subtrees of their contexts."""
        out = np.zeros(len(code))
        for k in range(8):
            node = _node(code, k)
            p, found = deep.one(node, k)
            for d in (1, 0):
                estimate, weight, known = (x[_shorter(node, d).astype(np.int64)] for x in self.levels[d])
                p = np.where(known, np.where(found, weight * estimate + (1 - weight) * p, estimate), p)
                found |= known
            out += np.log10(np.where(_bit(code, k), p, 1 - p))
        return out


# -- training ---------------------------------------------------------------


def _dealt_by(code: np.ndarray) -> np.ndarray:
    """The last two context bytes."""
    return (code >> np.uint64(8)) & np.uint64(0xFFFF)


def count_corpus(docs: DataFrame, train: F.Column, text: str, depth: int, buckets: int) -> DataFrame:
    """Counts of words and of byte n-grams over all rows where ``train``, in packed buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams = Counts()

        def word_rows() -> Iterator[pa.RecordBatch]:
            keys = list(words)
            yield from packed(_WORDS, word_keys(keys), np.fromiter(words.values(), np.int64, len(keys)), buckets)
            words.clear()

        def gram_rows() -> Iterator[pa.RecordBatch]:
            code, count = grams.take()
            yield from packed(_NGRAMS, code, count, buckets, _dealt_by(code))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                raw = bytes_of(batch.column(0).slice(at, SLICE_ROWS))
                for a, b in chunks(raw, COUNTED_BYTES):
                    texts = [x.translate(_LOWER) for x in raw[a:b]]
                    for x in texts:
                        words.update(x.split())
                    words[END] += b - a
                    code, _ = windows(texts, depth + 1)
                    grams.add(*np.unique(code, return_counts=True))
                    # Small parts share most n-grams: they are put together before it is asked whether a task holds too many.
                    if grams.full():
                        grams.add(*grams.take())
                    if len(words) > HELD_WORDS:
                        yield from word_rows()
                    if grams.full():
                        yield from gram_rows()
        yield from word_rows()
        yield from gram_rows()

    return sum_buckets(docs.where(train).select(text).mapInArrow(run, PACKED))


def _unpack(keys: pa.Array | pa.ChunkedArray, counts: pa.Array | pa.ChunkedArray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ascending) and counts of one bucket."""
    return np.frombuffer(keys[k].as_py(), "<u8"), np.frombuffer(counts[k].as_py(), "<i8")


def upper_levels(grams: DataFrame, depth: int) -> Upper:
    """The two upper levels, from sums over the buckets; the driver gets 65,280 rows at most."""

    def roots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in range(batch.num_rows):
            deep = Subtree(*_unpack(batch.column(0), batch.column(1), b), depth)
            for key, n0, n1, log in deep.roots:
                node, at = np.unique(_shorter(key, 1), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(pa.array(np.bincount(at, x, len(node))) for x in (n0, n1, log))], names=["node", "n0", "n1", "log"])

    made = map_arrow(grams.select("keys", "counts"), roots, "node bigint, n0 double, n1 double, log double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "log"))).toArrow()
    node, n0, n1, log = (np.ascontiguousarray(made.column(k).to_numpy()) for k in range(4))
    return Upper(node.view(np.uint64), n0, n1, log)


def _frequent(counted: DataFrame, kind: int, least: int, value: str, of) -> DataFrame:
    """``key`` and ``value`` of what was counted ``least`` times at least; ``of`` maps a bucket's keys, counts and choice to values."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in range(batch.num_rows):
            keys, counts = _unpack(batch.column(0), batch.column(1), b)
            often = counts >= least
            if often.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(of(keys, counts, often))], names=["key", value])

    return map_arrow(counted.where(F.col("kind") == kind).select("keys", "counts"), run, f"key bigint, {value} double")


def _table(df: DataFrame) -> tuple[HashArray, np.ndarray]:
    """Keys and values, of which there are fewer than ``2 ** HOT_BITS``, as a sorted hash array."""
    made = df.toArrow()
    table = HashArray(np.ascontiguousarray(made.column(0).to_numpy()).view(np.uint64))
    return table, made.column(1).to_numpy()[table.order]


# -- scoring ----------------------------------------------------------------

_SEGMENT = "segment string, keys array<{kind}>, held_out array<boolean>, n_tokens array<bigint>, n_bytes array<bigint>, n_known array<bigint>, base array<double>, score array<double>, requests array<struct<kind: int, bucket: int, docs: binary, asked: binary, times: binary>>"
_REQUESTS = pa.list_(pa.struct([("kind", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("asked", pa.binary()), ("times", pa.binary())]))


def _requests(kind: int, doc: np.ndarray, keys: np.ndarray, bucket: np.ndarray) -> list[dict]:
    """Distinct pairs of document and key with their numbers, packed by bucket."""
    order = np.lexsort((keys, doc, bucket))
    doc, keys, bucket = doc[order], keys[order], bucket[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])))) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(doc)))
    doc, keys, bucket = doc[first], keys[first], bucket[first]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else [0]
    return [{"kind": kind, "bucket": int(bucket[a]), "docs": doc[a:b].astype("<u4").tobytes(), "asked": keys[a:b].astype("<u8").tobytes(), "times": times[a:b].astype("<u4").tobytes()} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _segments(docs: DataFrame, key: str, text: str, depth: int, hot_words, hot_grams, buckets: int) -> DataFrame:
    """Texts scored by the broadcast words and n-grams, one row a segment, with requests for all others."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import uuid

        (words, word_value), (grams, gram_value) = hot_words.value, hot_grams.value
        raw = bytes_of(batch.column(1))
        for a, b in chunks(raw, SEGMENT_BYTES):
            texts = [x.translate(_LOWER) for x in raw[a:b]]
            score, requests = np.zeros(b - a), []
            far = []
            for s, e in chunks(texts, 1 << 19):
                code, sizes = windows(texts[s:e], depth + 1)
                place, doc = grams.find(code), np.repeat(np.arange(s, e), sizes)
                known = place >= 0
                if known.any():
                    score += np.bincount(doc[known], gram_value[place[known]], b - a)
                far.append((doc[~known], code[~known]))
            doc, code = (np.concatenate([x[k] for x in far]) for k in (0, 1))
            requests += _requests(_NGRAMS, doc, code, bucket_of(_dealt_by(code), buckets))
            codes: dict[bytes, int] = {}
            tokens, lengths = [], []
            for x in texts:
                w = x.split()
                w.append(END)
                lengths.append(len(w))
                tokens.append(np.fromiter((codes.setdefault(t, len(codes)) for t in w), np.int32, len(w)))
            token, doc = np.concatenate(tokens), np.repeat(np.arange(b - a, dtype=np.int32), lengths)
            keys = word_keys(list(codes))
            place = words.find(keys)
            value = np.where(place >= 0, word_value[np.maximum(place, 0)], 0) if len(word_value) else np.zeros(len(keys))
            known = (place >= 0)[token]
            asked = keys[token[~known]]
            requests += _requests(_WORDS, doc[~known], asked, bucket_of(asked, buckets))
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]), one(batch.column(0).slice(a, b - a).to_pylist(), batch.schema.field(0).type), one(batch.column(2).slice(a, b - a).to_pylist(), pa.bool_()),
                    one(lengths, pa.int64()), one([len(x) for x in texts], pa.int64()), one(np.bincount(doc[known], minlength=b - a), pa.int64()), one(np.bincount(doc, value[token] * known, b - a), pa.float64()), one(score, pa.float64()),
                    pa.array([requests], _REQUESTS),
                ],
                names=["segment", "keys", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score", "requests"],
            )

    return map_arrow(docs.select(key, text, "_held_out"), run, _SEGMENT.format(kind=kind))


_ANSWER = "segment string, kind int, docs binary, sums binary, known binary"


def _answer(upper, depth: int):
    """What one bucket answers: sums over requested words or n-grams, by segment and document."""

    def run(counted: pa.Table, asked: pa.Table) -> pa.Table:
        segments, kinds, docs, sums, known = [], [], [], [], []
        if asked.num_rows:
            kind = asked.column("kind")[0].as_py()
            keys, counts = _unpack(counted.column("keys"), counted.column("counts")) if counted.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            deep = Subtree(keys, counts, depth) if kind == _NGRAMS else None
            for segment, of, want, times in zip(*(asked.column(c).to_pylist() for c in ("segment", "docs", "asked", "times")), strict=True):
                want, of, times = np.frombuffer(want, "<u8"), np.frombuffer(of, "<u4"), np.frombuffer(times, "<u4")
                c = np.zeros(len(want))
                if kind == _NGRAMS:
                    distinct, at = np.unique(want, return_inverse=True)
                    value = upper.value.log10(distinct, deep)[at]
                else:
                    if len(keys):
                        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                        c = np.where(keys[place] == want, counts[place], 0)
                    value = np.log10(c + 0.1)
                doc, where = np.unique(of, return_inverse=True)
                segments.append(segment)
                kinds.append(kind)
                docs.append(doc.astype("<u4").tobytes())
                sums.append(np.bincount(where, value * times, len(doc)).tobytes())
                known.append(np.bincount(where, (c > 0) * times, len(doc)).astype("<i8").tobytes())
        return pa.table({"segment": pa.array(segments, pa.string()), "kind": pa.array(kinds, pa.int32()), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary()), "known": pa.array(known, pa.binary())})

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, folds: int = 10) -> DataFrame:
    """Learn from the rows not held out and score all: one row a document.

    Columns: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``bits_per_byte`` (of the text and its end).
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, held_out(F.col(key), folds).alias("_held_out"))
    buckets = bucket_count(docs)
    counted, _ = settle(count_corpus(rows, ~F.col("_held_out"), text, depth, buckets), "counts")
    sizes = {r["kind"]: (int(r["n"]), int(r["v"])) for r in counted.groupBy("kind").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).collect()}
    (n, v), (n_grams, _) = (sizes.get(k, (0, 0)) for k in (_WORDS, _NGRAMS))
    scale = float(np.log10(n + 0.1 * (v + 1)))
    upper = sc.broadcast(upper_levels(counted.where(F.col("kind") == _NGRAMS), depth))
    hot_words = sc.broadcast(_table(_frequent(counted, _WORDS, max(1, n >> HOT_BITS), "value", lambda keys, counts, often: np.log10(counts[often] + 0.1))))
    hot_grams = sc.broadcast(_table(_frequent(counted, _NGRAMS, max(1, n_grams >> HOT_BITS), "value", lambda keys, counts, often: upper.value.log10(keys[often], Subtree(keys, counts, depth)))))
    segments, _ = settle(_segments(rows, key, text, depth, hot_words, hot_grams, buckets), "scored")
    hot_words.unpersist()
    hot_grams.unpersist()
    asked = segments.select("segment", F.explode("requests").alias("r")).select("segment", "r.*")
    replies = counted.select("kind", "bucket", "keys", "counts").groupBy("kind", "bucket").cogroup(asked.groupBy("kind", "bucket")).applyInArrow(_answer(upper, depth), _ANSWER)

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        flat = {c: own.column(c).combine_chunks().flatten() if own.num_rows else None for c in ("keys", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score")}
        size = len(flat["keys"])
        base, known, whole = (np.array(flat[c].to_numpy()) for c in ("base", "n_known", "score"))
        # Sums are added in a fixed order, so that a score does not depend on how replies arrive.
        for kind, of, sums, times in sorted(zip(*(got.column(c).to_pylist() for c in ("kind", "docs", "sums", "known")), strict=True)):
            of = np.frombuffer(of, "<u4")
            (base if kind == _WORDS else whole)[of] += np.frombuffer(sums, "<f8")
            known[of] += np.frombuffer(times, "<i8")
        tokens = flat["n_tokens"].to_numpy()
        return pa.table({key: flat["keys"], "held_out": flat["held_out"], "n_tokens": flat["n_tokens"], "n_known": pa.array(known), "train_tokens": pa.array(np.full(size, n, np.int64)), "base_score": pa.array(base - tokens * scale), "score": pa.array(whole), "bits_per_byte": pa.array(-whole / np.log10(2) / (flat["n_bytes"].to_numpy() + 1))})

    own = segments.drop("requests")
    return own.groupBy("segment").cogroup(replies.groupBy("segment")).applyInArrow(finish, f"{key} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
