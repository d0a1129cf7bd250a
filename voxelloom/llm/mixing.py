"""Mixing sources to target weights by pivotal rounding. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.shared import store

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and a source's target against its size
GROUP = 256  # documents whose fractions one step of the tree settles
HEAVY = 50  # a document with more than 1 / HEAVY of its source's words is paired with the whole rest first


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: ``source, source_size, n_docs, weight, target``.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight. With sources in
    ascending order of ``limit / weight`` the stopped ones are a prefix, so one running sum finds the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[(place % len(weights)).cast("int")]
    weighed = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("heaviness", F.sum("weight").over(everything))
        .withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # What each unit of weight gets if exactly the sources before this one are stopped.
        .withColumn("level", (F.col("total") - F.col("used")) / (F.col("heaviness") - F.col("gone")))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("first", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything))
    )
    stopped = F.col("first").isNull() | (F.col("place") < F.col("first")["place"])
    target = F.when(stopped, F.col("limit")).otherwise(F.least(F.col("limit"), F.col("first")["level"] * F.col("weight")))
    return leveled.select("source", "source_size", "n_docs", "weight", target.cast("double").alias("target"))


def _uniform(seed: int, *parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _settle(group: Column, seed: int) -> Column:
    """Fold an array of ``(size, tie, doc_id, p)`` to settled ones (``p`` 0 or 1) and one that may stay fractional.

    Two fractions a and b of documents with sizes s and t: either a mass of words moves from the second to the
    first or the other way, as far as one of them becomes 0 or 1. The odds keep both expectations, and
    ``a * s + b * t`` never changes.
    """
    item = "struct<size:bigint,tie:bigint,doc_id:bigint,p:double>"
    start = F.struct(
        F.lit(None).cast(item).alias("open"), F.expr(f"cast(array() as array<{item}>)").alias("done")
    )

    def unit(of: Column, p: Column) -> Column:
        return F.struct(of["size"].alias("size"), of["tie"].alias("tie"), of["doc_id"].alias("doc_id"), p.alias("p"))

    def merge(state: Column, new: Column) -> Column:
        old = state["open"]
        s, t, a, b = old["size"], new["size"], old["p"], new["p"]
        up = F.least((1 - a) * s, b * t)  # words that can go from new to old
        down = F.least(a * s, (1 - b) * t)
        go_up = _uniform(seed, old["tie"], new["tie"], s, t) * (up + down) < down
        moved = F.when(go_up, up).otherwise(-down)
        # Whichever bound was the smaller is met exactly, without rounding.
        a_new = F.when(go_up & ((1 - a) * s <= b * t), 1.0).when(~go_up & (a * s <= (1 - b) * t), 0.0).otherwise(a + moved / s)
        b_new = F.when(go_up & (b * t <= (1 - a) * s), 0.0).when(~go_up & ((1 - b) * t <= a * s), 1.0).otherwise(b - moved / t)
        old_settled = (a_new == 0.0) | (a_new == 1.0)
        return F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(
                F.when(old_settled, unit(new, b_new)).otherwise(unit(old, a_new)).alias("open"),
                F.concat(state["done"], F.array(F.when(old_settled, unit(old, a_new)).otherwise(unit(new, b_new)))).alias("done"),
            )
        )

    return F.aggregate(group, start, merge, lambda state: F.concat(state["done"], F.array(state["open"])))


def _settle_heavy(heavy: DataFrame, seed: int) -> DataFrame:
    """``(source, items, q)``: each source's heavy documents settled, and the fraction left for its other ones.

    A heavy document is paired with all lighter documents at once: it becomes 0 or 1, and the mass it takes or
    leaves moves their common fraction ``q``. A source has fewer than ``HEAVY`` heavy documents.
    """
    item = F.struct("size", "tie", "doc_id", "p")
    grouped = heavy.groupBy("source", "source_size").agg(
        F.sort_array(F.collect_list(item), asc=False).alias("items"), F.sum("size").alias("heavy_size"), F.first("p").alias("p")
    )
    rest = F.col("source_size") - F.col("heavy_size")
    start = F.struct(F.col("p").alias("q"), F.expr("cast(array() as array<struct<size:bigint,tie:bigint,doc_id:bigint,p:double>>)").alias("done"))

    def merge(state: Column, new: Column) -> Column:
        q, share, p = state["q"], new["size"] / rest, new["p"]
        taken, left = q + (p - 1) * share, q + p * share
        drawn = _uniform(seed, new["tie"], new["size"]) < p
        # Only a choice that keeps q a fraction is possible; if none does, the nearer one is made.
        take = (
            F.when(rest == 0, drawn).when((taken >= 0) & (left > 1), True).when((taken < 0) & (left <= 1), False)
            .when((taken < 0) & (left > 1), q >= 0.5).otherwise(drawn)
        )
        q_new = F.when(rest == 0, q).when(take, F.greatest(taken, F.lit(0.0))).otherwise(F.least(left, F.lit(1.0)))
        unit = F.struct(new["size"].alias("size"), new["tie"].alias("tie"), new["doc_id"].alias("doc_id"), take.cast("double").alias("p"))
        return F.struct(q_new.alias("q"), F.concat(state["done"], F.array(unit)).alias("done"))

    folded = grouped.withColumn("folded", F.aggregate("items", start, merge))
    return folded.select("source", F.col("folded.done").alias("items"), F.col("folded.q").alias("q"))


def _settle_level(open_rows: DataFrame, groups: Column, level: int, seed: int) -> DataFrame:
    """One level of the tree: the same rows with new ``p``; at most one per group is still between 0 and 1."""
    item = F.struct("size", "tie", "doc_id", "p")
    grouped = (
        open_rows.withColumn("_group", F.pmod(F.xxhash64("tie", F.lit(level)), groups))
        .groupBy("source", "n_docs", "_group")
        .agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    )
    return grouped.select("source", "n_docs", F.explode(_settle(F.col("items"), seed + level)).alias("i")).select(
        "source", "n_docs", "i.size", "i.tie", "i.doc_id", "i.p"
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 10, group: int = GROUP
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    A source needs ``target / source_size`` copies of each of its documents: the whole part is given, the
    fraction is settled by pivotal rounding: heavy documents against all others, then a tree of groups of about
    ``group`` documents, largest first, so that the one left open is small. Groups are dealt by hash, hence a hot source is many groups. Each level
    keeps one open document per group and is written to the shared folder; the last one is drawn by its own
    fraction. The words taken from a source differ from its target by less than that one document.

    Null or wordless texts have size 0 and are taken 0 times. A null source is one more source. Rows with equal
    or null doc_ids stay apart. Reruns agree: draws are hashes of ids and sizes. An empty table gives an empty
    table. Other columns are not kept.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    rows = store(sized.withColumn("tie", F.xxhash64("doc_id", "size", "source")), "mix-sizes")
    targets = store(source_targets(rows, weights, most), "mix-targets")
    bound = targets.agg(F.count(F.lit(1)), F.sum(F.length("source")), F.max("n_docs")).first()
    small = bound[0] <= 100_000 and (bound[1] or 0) <= 8 << 20
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = targets.select(
        F.col("source").alias("_source"), "source_size", "n_docs", "target", F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("p"),
    )

    def with_shares(of: DataFrame, *columns: str) -> DataFrame:
        side = shares.select("_source", *columns)
        return of.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    unit = ["source", "n_docs", "size", "tie", "doc_id", "p"]
    shared_out = with_shares(rows, "n_docs", "p", "source_size")
    can_be_open, is_heavy = (F.col("size") > 0) & (F.col("p") > 0), F.col("size") * HEAVY > F.col("source_size")
    heavy = store(_settle_heavy(shared_out.where(can_be_open & is_heavy), seed), "mix-heavy")
    settled = [
        shared_out.where(~can_be_open).withColumn("p", F.lit(0.0)).select(*unit),
        heavy.select("source", F.lit(0).cast("long").alias("n_docs"), F.explode("items").alias("i")).select(
            "source", "n_docs", "i.size", "i.tie", "i.doc_id", "i.p"
        ),
    ]
    lighter = heavy.select(F.col("source").alias("_source"), "q")
    open_now = shared_out.where(can_be_open & ~is_heavy).join(
        F.broadcast(lighter) if small else lighter, F.col("source").eqNullSafe(F.col("_source")), "left"
    ).withColumn("p", F.coalesce("q", "p")).select(*unit)
    settled.append(open_now.where("p <= 0 or p >= 1"))
    still_open = open_now.where("p > 0 and p < 1")
    groups, most_open, level = F.ceil(F.col("n_docs") / group), bound[2] or 0, 0
    while most_open > 1:
        done = store(_settle_level(still_open, groups, level, seed), f"mix-level-{level}")
        whole = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        settled.append(done.where(whole))
        still_open = done.where(~whole)
        most_open, groups, level = -(-most_open // group), F.ceil(groups / group), level + 1
    last = F.when(_uniform(seed - 1, F.col("tie")) < F.col("p"), 1.0).otherwise(0.0)
    settled.append(still_open.withColumn("p", last))
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    return with_shares(every.drop("n_docs").withColumnRenamed("p", "extra"), "source_size", "target", "whole").select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, (F.col("whole") + F.col("extra").cast("int"))).otherwise(0).alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them; equal rows of one doc_id share their copies.

    Sizes are counted per doc_id first, so repeated ids neither multiply nor lose rows: each row of an id gets
    the id's mean number of copies, the first rows the remainder. Null ids match each other.
    """
    per_id = mixed.groupBy("doc_id").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    per_id = per_id.withColumnRenamed("doc_id", "_id")
    joined = docs.join(per_id, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    once = joined.where("_rows = 1").withColumn("_take", F.col("_copies"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("text", "source"))) - 1
    again = joined.where("_rows > 1").withColumn(
        "_take", F.floor(F.col("_copies") / F.col("_rows")) + (place < F.col("_copies") % F.col("_rows")).cast("int")
    )
    both = once.unionByName(again).where("_take > 0")
    return both.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_take").cast("int")))).select(*docs.columns)
