"""Operator 1: mixing sources to target weights by pivotal dependent rounding.

Only DataFrame and SQL functions.  A source's target divided by its size gives
each of its documents a number of copies: whole ones, and a fraction that must
become 0 or 1.  Two documents with fractions meet and words pass from one to
the other, at random in the direction that keeps either's expectation, until
one of them is integral and leaves.  So each meeting settles one document and
changes no total.  Groups of about GROUP documents settle all but one each;
what remains meets in groups of GROUP again, a reduction tree whose root rounds
one last document.  A source thus misses its target by less than the size of
one document, and every step's group is bounded whatever a source's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.common import materialize, word_count

GROUP = 64
WEIGHTS = (1, 2, 3)
MOST = 3
_UNIT = "struct<h: bigint, doc_id: bigint, source: string, size: bigint, rows: bigint, whole: bigint, m: double>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, units, target) from (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``most`` times its source's size and the excess is
    shared again by weight.  Sorted by where they stop, those that stop come
    first: the level of the others follows from running sums.  One row per
    source passes through the one-task window, not the documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    stop = most * F.col("source_size") / F.col("weight")
    after = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    before = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    # level: what a unit of weight gets if exactly those before this source stop
    level = (F.sum("source_size").over(W.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = weighed.withColumn("stop", stop).withColumn("level", level)
    first = F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", F.col("source").isNull(), "source", "level"))).over(W.partitionBy())
    return ranked.withColumn("level", F.coalesce(first["level"], F.lit(0.0))).select("source", "source_size", "units", F.least(F.col("weight") * F.col("level"), most * F.col("source_size").cast("double")).alias("target"))


def _random(*of: Column) -> Column:
    """Uniform in [0, 1), a function of its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _meet(state: Column, x: Column) -> Column:
    """One meeting of the unit held in state.c with x; settles either, keeps the other."""
    c = state["c"]
    room, spare = c["size"] - c["m"], x["size"] - x["m"]
    up, down = F.least(room, x["m"]), F.least(c["m"], spare)

    def settle(t: Column) -> Column:
        total = c["m"] + x["m"]
        rise = _random(c["h"], x["h"], F.lit(17)) * (t["up"] + t["down"]) < t["down"]
        rise = rise | (t["up"] + t["down"] <= 0)
        c_leaves = F.when(rise, room <= x["m"]).otherwise(c["m"] <= spare)
        left = F.when(rise & c_leaves, total - c["size"]).when(~rise & ~c_leaves, total - x["size"]).otherwise(total)
        gone = F.when(c_leaves, rise).otherwise(~rise)
        stays = F.when(c_leaves, x).otherwise(c)
        goes = F.when(c_leaves, c).otherwise(x)
        held = stays.withField("m", F.greatest(F.lit(0.0), F.least(left, stays["size"].cast("double"))))
        done = goes.withField("m", F.when(gone, goes["size"].cast("double")).otherwise(0.0))
        return F.struct(held.alias("c"), F.concat(state["out"], F.array(done)).alias("out"))

    return _let(F.struct(up.alias("up"), down.alias("down")), settle)


def _settled(unit: Column) -> list[Column]:
    taken = F.when(unit["m"] > 0, 1).otherwise(0)
    return [unit[k].alias(k) for k in ("doc_id", "source", "size", "rows")] + [(unit["whole"] + taken).cast("long").alias("copies")]


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, rows, copies, source_size, target), one row per distinct doc_id, source and size.

    ``rows`` counts the equal rows of docs, ``copies`` what the mix takes of
    them together, at most ``most`` a row.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    units = materialize(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    goals = materialize(targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most), "mix-targets")
    share = F.try_divide(F.col("target"), F.col("source_size")) * F.col("rows")  # null for a source without words
    joined = units.alias("u").join(goals.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.*", "source_size", "target", "units", F.coalesce(share, F.lit(0.0)).alias("share"))
    # a whole number of copies must not lose one to the last digit
    whole = F.floor(F.col("share") + 1e-9)
    start = joined.withColumn("whole", whole).withColumn("m", F.greatest(F.lit(0.0), F.col("share") - F.col("whole")) * F.col("size")).withColumn("h", F.xxhash64("doc_id", "source", "size"))
    unit = F.struct("h", "doc_id", "source", "size", "rows", "whole", "m").cast(_UNIT).alias("unit")
    # of documents without words any number may be taken
    empty = start.where("size = 0 or m <= 0").select("doc_id", "source", "size", "rows", F.col("whole").alias("copies"))
    groups = F.ceil(F.col("units") / GROUP)
    live = start.where("size > 0 and m > 0").select(F.col("source").alias("of"), F.pmod(F.xxhash64("h", F.lit(3)), groups).alias("g"), unit)
    most_units = goals.agg(F.max("units")).first()[0] or 0
    level, out = -(-most_units // GROUP), [empty]
    while level:
        folded = live.groupBy("of", "g").agg(F.array_sort(F.collect_list("unit")).alias("units"))
        state = F.aggregate(F.expr("slice(units, 2, size(units))"), F.struct(F.col("units")[0].alias("c"), F.array().cast(f"array<{_UNIT}>").alias("out")), _meet)
        folded = materialize(folded.select("of", "g", state.alias("s")), "mix-level")
        out.append(folded.select(F.explode("s.out").alias("x")).select(*_settled(F.col("x"))))
        live = folded.select("of", F.floor(F.col("g") / GROUP).alias("g"), F.col("s.c").alias("unit"))
        level = 0 if level == 1 else -(-level // GROUP)
    last = F.col("unit").withField("m", F.when(_random(F.col("unit.h"), F.lit(29)) * F.col("unit.size") < F.col("unit.m"), F.col("unit.size").cast("double")).otherwise(0.0))
    out.append(live.select(last.alias("x")).select(*_settled(F.col("x"))))
    settled = out[0]
    for part in out[1:]:
        settled = settled.unionByName(part)
    return settled.alias("s").join(goals.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0; a null source is a source of its own.  Equal rows
    are rounded together and share the copies as evenly as can be.  Columns
    besides doc_id, text and source are not read.  No rows give no rows.
    """
    found = copies(docs, weights, most)
    each = found.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    own = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("j") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return each.withColumn("copies", own.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: every row of docs as often as it is taken, numbered by a new column ``copy`` from 1.

    A column of docs called copy is replaced.
    """
    # the rows' own columns travel in one, so that their names clash with none here
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copy")).alias("row")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")).withColumn("key", F.xxhash64("doc_id", "source", "size"))
    found = copies(docs, weights, most).select(F.struct("doc_id", "source", "size").alias("of"), F.xxhash64("doc_id", "source", "size").alias("key"), "rows", "copies")
    joined = rows.join(found, "key").where(F.struct("doc_id", "source", "size").eqNullSafe(F.col("of")))
    numbered = joined.withColumn("j", F.row_number().over(W.partitionBy("key", "of").orderBy("key")))
    times = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("j") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    taken = numbered.withColumn("times", times.cast("int")).where("times > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
