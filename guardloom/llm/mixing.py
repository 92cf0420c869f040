"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key (MD5 of its id and text).  Rows are dealt to ranges of that
key within each source; range sums are prefixed level by level, so no window ever
holds more than one range.  A row is taken as often as its source's budget passes
over its stretch of the source's word line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardloom.llm.common import WORD, materialise, word_count

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Rows that one key range of one source holds, about.
RANGE_ROWS = 1024


def _source_key(source: Column) -> Column:
    """A key without nulls, other than any source's own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _row_key() -> Column:
    """MD5 of the id and the text's own MD5, so rows that share an id, or have none, do not share a key."""
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn.  Together they
    get ``share`` of all sizes; none gets more than ``max_epochs`` times its own, and
    what it cannot take goes to the others by weight.  The level at which that comes
    to rest is found in closed form: by rising cap per weight, the first source whose
    share of what is left fits under its cap sets the level for all after it (shares
    computed further on only fall, so it is the largest share that fits).

    One row per source: the windows here hold the sources, never the rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    position = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1))
    weighed = weighed.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    weighed = weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / heavy)
    rest = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * rest, F.col("cap")))
    return levelled.withColumn("target", target).select("source", "source_size", "target")


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS,
    range_rows: int = RANGE_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How much of each row the mix takes.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; of other columns those named in
    ``carry`` stay.  Returns doc_id, source, size, source_size, target, word_start (words
    of the source before this row in the mixing order), budget and taken.

    Null or empty texts have size 0 and are taken 0 times; null sources are one source,
    the last; repeated rows count as often as they occur, and among them it is undefined
    which one the budget ends in (they are alike).  Texts of any length are counted whole; an
    empty table gives no rows; columns that are not named are ignored, whatever their names.
    """
    own = [F.col(c).alias(f"__{c}") for c in carry]
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        _row_key().alias("key"),
        *own,
    )
    if not carry:  # small rows: count the words once
        sized = materialise(sized, "mix-sizes")
    digits = max(2, math.ceil(math.log(docs.count() / range_rows + 1, 16)))
    sized = sized.withColumns(
        {
            "skey": _source_key(F.col("source")),
            "block": F.substring("key", 1, digits // 2),
            "range": F.substring("key", 1, digits),
        }
    )
    ranges = sized.groupBy("skey", "source", "block", "range").agg(F.sum("size").alias("words"))
    if carry:
        ranges = materialise(ranges, "mix-ranges")
    blocks = ranges.groupBy("skey", "source", "block").agg(F.sum("words").alias("words"))
    totals = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs)
    targets = targets.withColumn("skey", _source_key(F.col("source"))).drop("source")

    def earlier(words: str, by: list[str], order: list[str]) -> Column:
        line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(words).over(line), F.lit(0))

    block_start = blocks.select("skey", "block", earlier("words", ["skey"], ["block"]).alias("block_start"))
    range_start = ranges.select(
        "skey", "block", "range", earlier("words", ["skey", "block"], ["range"]).alias("range_start")
    )
    starts = (
        range_start.join(block_start, ["skey", "block"])
        .join(targets, "skey")
        .select("skey", "range", (F.col("block_start") + F.col("range_start")).alias("start"), "source_size", "target")
    )
    placed = sized.withColumn("own", earlier("size", ["skey", "range"], ["key", "doc_id", "size"]))
    placed = placed.join(starts, ["skey", "range"])
    part = F.col("budget") - F.col("epochs") * F.col("source_size")
    return (
        placed.withColumn("word_start", F.col("start") + F.col("own"))
        .withColumn("budget", F.floor("target").cast("long"))
        .withColumn("epochs", F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0L END"))
        .withColumn(
            "taken",
            F.col("epochs") * F.col("size") + F.least(F.greatest(part - F.col("word_start"), F.lit(0)), F.col("size")),
        )
        .select("doc_id", "source", "size", "source_size", "target", "word_start", "budget", "taken", *[f"__{c}" for c in carry])
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: ``docs``' own columns, each row as often as it is taken.

    The row that a budget ends in comes, the last time, with its words up to the cut
    (its text stops before the first word beyond, and ``n_chars``, if there is one,
    follows it).  Rows without words have no part in a mix.
    """
    plan = plan_mix(docs, carry=tuple(docs.columns), **how).where("taken > 0")
    copies = plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")).cast("int")
    pieces = F.regexp_extract_all("__text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(words < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), words), "")).otherwise(F.col("__text"))
    out = {c: F.col(f"__{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(words < F.col("size"), F.length(text)).otherwise(F.col("__n_chars")).cast(kind)
    return copies.select(*[out[c].alias(c) for c in docs.columns])
