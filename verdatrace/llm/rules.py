"""Quality rules: shape of a text, and its n-gram perplexity within bands by language.

Spark counts the byte 5-grams of all texts by language, and from these an
interpolated modified Kneser-Ney model of every language is made by grouping and
joining: continuation counts of the shorter orders, counts of counts, context
totals, and then probabilities from the shortest order up.  The model learns
from *plain* texts: those that pass the base rules, have at most one symbol in
a hundred words and no line twice.  Judged are all texts, so the table of values
has every n-gram of the corpus, also those that no plain text has.

Values are looked up in two ways with one result.  N-grams with at least a
``2 ** HOT_BITS``-th of all occurrences (fewer than ``2 ** HOT_BITS``) go to the
executors as a sorted hash array.  All others leave the pass over the texts as
``document, n-gram, times`` and are joined to the table of values; none is left out.

A text is rejected if it fails a base rule, or if its perplexity lies outside
the lower and upper limits of its language.  The limits are robust: the median of
the bits per byte of all texts of the language that pass the base rules, and so
many times their typical spread around it.  Every language has a model and
limits of its own.

Nulls, empties and the rest: a null text has no words and fails the base rules;
a null language counts as the empty one; very long texts are taken in steps of
bounded memory; ties and repeated rows (null or repeated keys too) are judged
one by one; columns other than key, language and text are not read; a language
without plain texts gives every byte 8 bits, so its limits reject nothing; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import BROADCAST_KEYS, bytes_of, chunks, map_arrow, settle
from verdatrace.llm.ngrams import Counts, HashArray, windows

#: Order of the model, in bytes.
ORDER = 5
#: An n-gram is broadcast with a 2 ** HOT_BITS-th of all occurrences.
HOT_BITS = 22
#: Spreads below and above the median of a language at which a text is rejected.
SPREADS = 12.0
#: Least spread in bits per byte, for languages whose texts are all alike.
LEAST_SPREAD = 0.01
#: Steps of a bit in which bits per byte are counted for the limits.
STEPS = 1024

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"


def shape(text: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.split()
    word_chars = n_chars - (len(text) - len(text.translate(None, _SPACE)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        times, reach = Counter(grams), 0
        for k, g in enumerate(grams):
            if times[g] > 1:
                repeated += k + 3 - max(k, reach)
                reach = k + 3
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


def fails(n_words: int, n_repeat_words: int) -> bool:
    """The base rule."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def plain(found: tuple[int, int, int, int, int]) -> bool:
    """Whether a text of this shape is one to learn from."""
    n_words, _, n_symbols, n_dup_lines, n_repeat_words = found
    return not fails(n_words, n_repeat_words) and 100 * n_symbols <= n_words and not n_dup_lines


# -- the model --------------------------------------------------------------


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """All byte n-grams of order ORDER: ``lang``, ``gram``, ``c`` (in all texts) and ``n`` (in plain texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for of, counts in held.items():
                keys, both = counts.take()
                for k in range(0, len(keys), 200_000):
                    part = both[k : k + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array([of]).take(pa.array(np.zeros(len(part), np.int32))), pa.array(keys[k : k + 200_000].view(np.int64)), pa.array(part & 0xFFFFFFFF), pa.array(part >> 32)], names=["lang", "gram", "c", "n"])
            held.clear()

        for batch in batches:
            by: dict[tuple[str, bool], list[bytes]] = {}
            for x, of in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                by.setdefault((of, plain(shape(x, 0))), []).append(x)
            for (of, learn), texts in by.items():
                for a, b in chunks(texts):
                    keys, counts = np.unique(windows(texts[a:b], ORDER)[0], return_counts=True)
                    # Both counts in one number; a task hands on long before either outgrows its half.
                    held.setdefault(of, Counts()).add(keys, counts * ((1 << 32) + 1 if learn else 1))
                if sum(x.held for x in held.values()) > 1_500_000:
                    yield from rows()
        yield from rows()

    return docs.select(text, _language(lang).alias("lang")).mapInArrow(run, "lang string, gram bigint, c bigint, n bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _few(df: DataFrame) -> DataFrame:
    """A table with a row for each language, broadcast if there are few by its count."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def discounts(table: DataFrame) -> DataFrame:
    """``order``, ``lang`` and the discounts ``d1``, ``d2``, ``d3`` from the counts of counts ``n``."""
    ones = table.groupBy("order", "lang").agg(*(F.greatest(F.count_if(F.col("n") == k), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return ones.select("order", "lang", *(F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The table of values: ``lang``, ``gram``, ``c`` (occurrences) and ``bits``, minus the log2 of the probability of its last byte after the others."""
    tables = {ORDER: settle(count_grams(docs, lang, text), "grams")[0]}
    for m in range(ORDER - 1, 0, -1):
        # A shorter n-gram counts the different bytes that it follows in plain texts.
        shorter = tables[m + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n"))
        tables[m] = settle(shorter, "grams")[0] if m > 2 else shorter  # there are few of the shortest
    every = [tables[m].select(F.lit(m).alias("order"), "lang", "n") for m in tables]
    each, _ = settle(discounts(reduce(DataFrame.unionAll, every)), "discounts")
    lower, each = None, _few(each)
    for m in range(1, ORDER + 1):
        off = each.where(F.col("order") == m).drop("order")
        own = tables[m].join(off, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).when(F.col("n") > 2, F.col("d3")).otherwise(0.0)).drop("d1", "d2", "d3")
        own = own.withColumn("context", F.shiftright("gram", 8))
        # What the discounts take goes to the shorter n-grams; a context that was never seen leaves all to them.
        contexts = own.where("n > 0").groupBy("lang", "context").agg(F.sum("n").alias("whole"), F.sum("d").alias("off"))
        if lower is None:
            joined = own.join(contexts, ["lang", "context"], "left").withColumn("shorter", F.lit(1 / 256))
        else:
            short = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
            joined = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(contexts, ["lang", "context"], "left").join(short, ["lang", "suffix"])
        p = F.coalesce((F.col("n") - F.col("d")) / F.col("whole"), F.lit(0.0)) + F.coalesce(F.col("off") / F.col("whole"), F.lit(1.0)) * F.col("shorter")
        lower = joined.select("lang", "gram", *(["c"] if m == ORDER else []), p.alias("p"))
    return settle(lower.select("lang", "gram", "c", (-F.log2("p")).alias("bits")), "values")[0]


# -- judging ----------------------------------------------------------------

_MEASURED = "row bigint, key {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, hot double, cold array<struct<gram: bigint, times: bigint>>"


def measure(docs: DataFrame, values: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Shape and bits per byte (of the text and its end) of every text, by the values of :func:`fit` over texts that these are among."""
    kind = docs.schema[key].dataType.simpleString()
    whole = values.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = values.where(F.col("c") * (1 << HOT_BITS) >= whole).select("lang", "gram", "bits").toArrow()
    of_lang = hot.column(0).combine_chunks().dictionary_encode() if hot.num_rows else pa.array([], pa.string()).dictionary_encode()
    number = {x: k for k, x in enumerate(of_lang.dictionary.to_pylist())}
    table = HashArray(np.ascontiguousarray(hot.column(1).to_numpy()).view(np.uint64) | (of_lang.indices.to_numpy().astype(np.uint64) << np.uint64(8 * ORDER)))
    shared = docs.sparkSession.sparkContext.broadcast((number, table, hot.column(2).to_numpy()[table.order]))
    cold_type = pa.struct([("gram", pa.int64()), ("times", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number, table, bits = shared.value
        raw = bytes_of(batch.column(3))
        for a, b in chunks(raw):
            texts = raw[a:b]
            of = np.array([number.get(x, len(number)) for x in batch.column(2).slice(a, b - a).to_pylist()], np.uint64)
            # Places of UTF-8's continuation bytes hold no code points of their own.
            shapes = np.array([shape(x, len(x.decode("utf-8", "surrogateescape"))) for x in texts], np.int64)
            code, lengths = windows(texts, ORDER)
            place = table.find(code | np.repeat(of << np.uint64(8 * ORDER), lengths))
            known = place >= 0
            value = np.zeros(len(code))
            value[known] = bits[place[known]]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            doc = np.repeat(np.arange(b - a, dtype=np.int64), lengths)[~known]
            order = np.lexsort((code[~known], doc))
            doc, gram = doc[order], code[~known][order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])))) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(doc)))
            cold = pa.StructArray.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(times)], fields=list(cold_type))
            cuts = np.searchsorted(doc[first], np.arange(b - a + 1)).astype(np.int32)
            rest = [batch.column(k).slice(a, b - a) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(shapes[:, k]) for k in range(5)), pa.array(lengths), pa.array(np.add.reduceat(value, starts)), pa.ListArray.from_arrays(pa.array(cuts), cold)], names=["row", "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "hot", "cold"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), _language(lang).alias("lang"), F.col(text).alias("t"))
    found, _ = settle(map_arrow(rows, run, _MEASURED.format(kind=kind)), "measured")
    # Each n-gram here has less than a 2 ** HOT_BITS-th of all occurrences, so no key is hot.
    rare = found.select("row", "lang", F.explode("cold").alias("x")).select("row", "lang", "x.gram", "x.times").join(values.select("lang", "gram", "bits"), ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("bits")).alias("rest"))
    return found.join(rare, "row", "left").select("row", "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ((F.col("hot") + F.coalesce("rest", F.lit(0.0))) / F.col("n_bytes")).alias("bits"))


def limits(measured: DataFrame) -> DataFrame:
    """``lang``, ``low`` and ``high``: limits of the bits per byte, from all texts that pass the base rules.

    Medians are taken over steps of a bit, so a task holds a few thousand
    different values of a language, however many texts there are.
    """
    passed = measured.where(~F.col("base_failed")).select("lang", F.floor(F.col("bits") * STEPS).alias("step"))
    middle, _ = settle(passed.groupBy("lang").agg(F.percentile("step", 0.5).alias("middle")), "medians")
    spread = passed.join(_few(middle), "lang").groupBy("lang", "middle").agg(F.percentile(F.abs(F.col("step") - F.col("middle")), 0.5).alias("mad"))
    room = SPREADS * F.greatest(1.4826 * F.col("mad") / STEPS, F.lit(LEAST_SPREAD))
    return spread.select("lang", (F.col("middle") / STEPS - room).alias("low"), ((F.col("middle") + 1) / STEPS + room).alias("high"))


def judge(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """One row a document: ``key``, the shape, ``base_failed``, ``kept``, ``perplexity`` (by byte)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured, _ = settle(measure(docs, fit(docs, lang, text), key, lang, text).withColumn("base_failed", failed), "judged")
    band, _ = settle(limits(measured), "limits")
    inside = F.coalesce((F.col("bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(True))
    return measured.join(_few(band), "lang", "left").select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"))
