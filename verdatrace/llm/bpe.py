"""Byte-level BPE encoding and decoding by monoid tree reduction.

An encoding is an element of a monoid: the empty encoding is neutral and
``join`` combines the encodings of two neighbouring byte strings into that of
their concatenation.  ``join`` rests on a known property of rank-ordered BPE: a
token sequence is *the* encoding of its bytes exactly when every two adjacent
tokens, taken alone, encode to themselves ("the pair is stable").  So only the
tokens around the seam can change: a window over the seam is encoded anew and
grown until the pairs at both of its edges are stable; everything outside it
provably stays.  Long pieces are cut in halves recursively down to short leaves,
which makes one piece of n bytes cost about n log n rather than n squared.

The pattern of the vocabulary splits a text first; no merge crosses a match, so
above that level joining is plain concatenation.  Decoding concatenates byte
strings up the same kind of tree.

Nulls, empties and the rest: a null text counts as empty and gives no ids;
repeated rows, null ids and extra columns pass through unchanged (a column of
the result's name is replaced); an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdatrace.llm.common import map_arrow, texts_of, with_fields

#: Bytes up to which a leaf of the tree is merged directly.
LEAF_BYTES = 16
#: Memoised matches (and stable pairs) of a worker, at most.
MEMO_ENTRIES = 400_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64(token) rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.matches = regex.compile(pattern).findall
        self._stable: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    # -- the monoid ---------------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Encode a short byte string by repeated lowest-rank merges."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.tokens)
        costs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether the adjacent tokens encode to themselves."""
        key = (a, b)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) >= MEMO_ENTRIES:
                self._stable.clear()
            known = self._stable[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring byte strings from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        lo, hi, grow = len(left) - 1, 1, 1
        while True:
            window = self.merge(b"".join(self.tokens[t] for t in left[lo:] + right[:hi]))
            left_ok = lo == 0 or self.stable(left[lo - 1], window[0])
            right_ok = hi == len(right) or self.stable(window[-1], right[hi])
            if left_ok and right_ok:
                return left[:lo] + window + right[hi:]
            lo = lo if left_ok else max(0, lo - grow)
            hi = hi if right_ok else min(len(right), hi + grow)
            grow *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        """Encode one match of the pattern: halves recursively, joined up the tree."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._reduce(piece)

    def _reduce(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        mid = len(piece) // 2
        return self.join(self._reduce(piece[:mid]), self._reduce(piece[mid:]))

    # -- texts --------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.matches(text))), "<u4")

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of the ids, concatenated up a balanced tree."""
        if len(ids) <= 8192:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class _Memo(dict):
    """From a match to its packed ids; forgets everything when full."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        packed = np.array(self.bpe.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


_loaded: dict[tuple[str, str], ByteBPE] = {}


def _worker(data: bytes, pattern: str) -> ByteBPE:
    """One encoder a worker process and vocabulary."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(load_ranks(data), pattern)
    return _loaded[key]


def _vocabulary(df: DataFrame, path: str):
    """The rank file, sent once to each executor; its size is that of the vocabulary, never of the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as a binary column (little-endian unsigned 32-bit); null: no ids."""
    df = df.drop(out)
    data, place = _vocabulary(df, path), df.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _worker(data.value, pattern)
        ids = [bpe.encode(x).tobytes() for x in texts_of(batch.column(place))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, out])

    return map_arrow(df, run, with_fields(df, f"{out} binary"))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the packed ids stand for as a binary column; null: no bytes."""
    df = df.drop(out)
    data, place = _vocabulary(df, path), df.columns.index(ids)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = _worker(data.value, r"(?s).+")
        made = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(place).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    return map_arrow(df, run, with_fields(df, f"{out} binary"))


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: str | None = None) -> DataFrame:
    """Encode, decode and digest every text in one pass.

    Columns: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``,
    ``lossless`` (whether the decoded bytes are those of the text) and, if
    ``ids`` names it, an array of the ids.  One row a row of ``df``, repeated
    and null keys included.
    """
    data, ids_name = _vocabulary(df, path), ids
    rows = df.select(key, text)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean" + (f", {ids} array<int>" if ids else "")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe, n, first, second, same, kept = _worker(data.value, pattern), [], [], [], [], []
        for x in texts_of(batch.column(1)):
            ids = bpe.encode(x)
            back = bpe.decode(ids.tolist())
            n.append(len(ids))
            first.append(hashlib.sha256(ids).hexdigest())
            second.append(hashlib.sha256(back).hexdigest())
            same.append(back == x.encode())
            if ids_name:
                kept.append(ids)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second), pa.array(same)]
        if ids_name:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(kept).view(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless", *([ids_name] if ids_name else [])])

    return map_arrow(rows, run, schema)
