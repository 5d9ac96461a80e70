"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidates with their places in code points.  The hash of every
candidate's value is aggregated over the whole corpus by distinct owners and
repositories: a value that ``EXAMPLE_OWNERS`` or more owners have is a widely
copied example; one that a single owner has is live-looking.  Beside the base
kinds (assignments, access keys, hexadecimal runs), long mixed tokens outside
any base span become findings of kind ``token`` where one owner alone has them;
the corpus decides about these, since their pattern says little.

Distinct (value, owner, repository) triples are formed before counting, so a
value in a third of all rows costs as many rows as it has owners.

Nulls, empties and the rest: a null text has no spans; null owners and
repositories count as one more owner or repository; rows with null or repeated
keys are reported one by one; a text of any length and number of matches is
walked in order; spans that begin together are listed by kind; columns that
clash with names used here are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdatrace.llm.common import join_keyed, settle

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of at least 32 characters are the only ones that count, and a run that long is found whole either way.
_ACCESS_LONG, _HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: A long token; it must also mix letters and digits.
TOKEN = r"[A-Za-z0-9_-]{24,}"
KINDS = ("assign", "access", "hex", "token")
#: Owners from which on a value is a copied example.
EXAMPLE_OWNERS = 3


def matches(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches in order: (rank, pos, gap, size, value); ``gap`` are the code points since the match before.

    The pieces between the matches and the matches themselves alternate, so
    running sums of their lengths are the places (:func:`placed`).
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    steps = F.transform(pieces, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), F.char_length(x["g"]).cast("bigint").alias("gap"), F.char_length(x["m"]).cast("bigint").alias("size"), x["v"].alias("value")))
    # Most texts have no match at all; those take one look.
    return F.when(text.rlike(pattern), steps).otherwise(F.array().cast("array<struct<rank: int, pos: int, gap: bigint, size: bigint, value: string>>"))


def _written(items: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, key: Column, text: Column, owner: Column, repo: Column) -> DataFrame:
    """``row``, ``key``, ``owner``, ``repo``, and the matches of all patterns as ``hits``."""
    whole = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("t"), owner.alias("owner"), repo.alias("repo"))
    t = F.col("t")
    hits = F.concat(matches(t, ASSIGN, 0, 2), matches(t, _ACCESS_LONG, 1), matches(t, _HEX_LONG, 2), matches(t, TOKEN, 3))
    return whole.select(F.monotonically_increasing_id().alias("row"), "key", "owner", "repo", hits.alias("hits"))


def placed(found: DataFrame) -> DataFrame:
    """One row a candidate: ``row``, ``owner``, ``repo``, ``rank``, ``start``, ``end``, ``value``; places in code points, end exclusive.

    Places are running sums within a document and kind.  A token counts only
    outside all base spans: neither does one that begins before it reach into it,
    nor does the next one begin within it.
    """
    each = found.select("row", "owner", "repo", F.explode("hits").alias("h")).select("row", "owner", "repo", "h.*").repartition("row")
    so_far = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    value, base = F.col("value"), F.col("rank") < 3
    each = each.where((F.col("rank").isin(1, 2)) | ((F.col("rank") == 0) & (F.char_length(value) >= 8)) | ((F.col("rank") == 3) & value.rlike("[0-9].*[0-9].*[0-9].*[0-9]") & value.rlike("[A-Za-z]")))
    order = Window.partitionBy("row").orderBy("start", "rank")
    each = each.withColumn("reach", F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    return each.where(base | free).select("row", "owner", "repo", "rank", "start", "end", "value", F.xxhash64("value").alias("value_hash"))


def ownership(each: DataFrame) -> DataFrame:
    """``value_hash``, ``n_owners`` and ``n_repos`` of every candidate value of the corpus."""
    named = each.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    pairs = named.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return pairs.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row a document with all spans and what the corpus says about them.

    Columns: ``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans``, ``n_token``, ``n_live`` (spans whose value one owner alone has),
    ``n_example`` (spans whose value EXAMPLE_OWNERS or more have).
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found, _ = settle(candidates(docs, F.col(key), F.col(text), owner.cast("string"), repo.cast("string")), "secrets")
    each, _ = settle(placed(found.where(F.size("hits") > 0)), "candidates")
    span, rank, alone = F.struct("start", "rank", "end"), F.col("rank"), F.col("n_owners") == 1
    judged = join_keyed(each, ownership(each), "value_hash").groupBy("row").agg(
        *(F.count_if(rank == k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.collect_list(F.when(rank < 3, span)).alias("base"),
        F.collect_list(F.when((rank < 3) | alone, span)).alias("every"),
        F.count_if((rank == 3) & alone).alias("n_token"),
        F.count_if(alone).alias("n_live"),
        F.count_if(F.col("n_owners") >= EXAMPLE_OWNERS).alias("n_example"),
    )
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("row", "key").join(judged, "row", "left").select(
        F.col("key").alias(key),
        *(number(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_written(F.coalesce("base", none)).cast("binary"), 256).alias("base_sha256"),
        _written(F.coalesce("every", none)).alias("spans"),
        *(number(c) for c in ("n_token", "n_live", "n_example")),
    )
