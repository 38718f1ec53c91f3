"""Mixing of sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, again and again up to `most` times. A queued copy's virtual
finish time is the source's words up to and with it, divided by the source's target. The copies of all sources are
range-sorted by that time, and the sorted mix is cut where its running sum of words reaches the total budget. A copy in
which its source reaches its target is two packets, that up to the target and the rest, so the cut may fall between
them: then a source takes its target to the word, however long its documents are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from . import common

#: Rows of a bucket within which documents are put into shuffled order by one window task. Buckets of over HOT times as
#: many, such as that of one repeated id, are cut up by row.
BUCKET_ROWS = 2_000
HOT = 8
SEED = 20240101


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """Adds weight: the weights in turn over the sources by code point, null last. A row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    return sizes.withColumn("weight", pick)


def fair_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to sizes(source, source_size, weight): weights share `share` times all words, no target goes
    beyond `most` times its source, and what is above is shared again by weight until nothing is.

    With sources by ascending cap/weight, the first k are at their caps; k is the first at which the rest's level
    lies below the next cap. Sources are rows of one small table, so its windows are single tasks on purpose.
    """
    cap = F.col("source_size") * F.lit(most)
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("ratio", cap / F.col("weight"))
    t = t.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(share),
        "capped": F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("budget") - F.col("capped")) / F.col("open_weight")
    first = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("open", F.when(level <= F.col("ratio"), level)).withColumn("level", F.first("open", ignorenulls=True).over(first))
    return t.withColumn("target", F.least(cap, F.col("weight") * F.coalesce("level", F.lit(float("inf"))))).select("source", "source_size", "weight", "target")


def queued(docs: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds to docs(row, doc_id, source, size) of the sources in targets: target, source_size, before (words of the source queued before it).

    The place in the queue is a hash of doc_id, so reruns agree. Each source's queue is cut into buckets by that hash,
    as many as its rows need; sums by bucket give where each begins, and only a bucket is ever sorted in one task. Rows
    of one id share a hash; a bucket that is hot for that is cut up by a hash of the row.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    plan = targets.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(BUCKET_ROWS))).cast("long"))
    keyed = docs.join(common.small_side(plan, plan.count()), docs["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    # the hash's place in its range, as a fraction, tells the bucket: buckets follow each other in hash order
    keyed = keyed.withColumn("key", key).withColumn("bucket", F.least(F.floor(F.col("key").cast("double") / F.lit(2.0**60) * F.col("buckets")), F.col("buckets") - 1)).withColumn("sub", F.lit(0).cast("long"))
    hot = common.written(keyed.groupBy("source", "bucket").count().where(F.col("count") > HOT * BUCKET_ROWS).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.ceil(F.col("count") / BUCKET_ROWS).alias("subs")), "mix-hot")
    n_hot = hot.count()
    if n_hot:
        marked = keyed.join(common.small_side(hot, n_hot), keyed["source"].eqNullSafe(hot["s"]) & (keyed["bucket"] == hot["b"]), "left")
        keyed = marked.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("row"), F.col("subs")), F.lit(0)).cast("long")).drop("s", "b", "subs")
    else:
        common.drop_written(hot)
    sums = keyed.groupBy("source", "bucket", "sub").agg(F.sum("size").alias("n"))
    so_far = Window.partitionBy("source").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    begin = common.written(sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("sub").alias("c"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("begin")), "mix-begins")
    within = Window.partitionBy("source", "bucket", "sub").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = placed["source"].eqNullSafe(begin["s"]) & (placed["bucket"] == begin["b"]) & (placed["sub"] == begin["c"])
    return placed.join(common.small_side(begin, begin.count()), same).withColumn("before", F.col("begin") + F.col("inside")).drop("key", "bucket", "buckets", "sub", "s", "b", "c", "begin", "inside", "n_docs")


def packets(rows: DataFrame, most: float) -> DataFrame:
    """row, copy, opens (whether it begins its copy), words and finish of the packets of all copies of queued rows. A copy is one packet, or two where its source reaches its target in it."""
    goal = F.floor("target")
    copies = rows.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(1, -int(-most // 1)) - 1)))).withColumn("start", F.col("copy") * F.col("source_size") + F.col("before"))
    end = F.col("start") + F.col("size")
    whole = F.array(F.struct(F.col("start").alias("lo"), end.alias("hi")))
    halves = F.array(F.struct(F.col("start").alias("lo"), goal.alias("hi")), F.struct(goal.alias("lo"), end.alias("hi")))
    cut = copies.withColumn("p", F.explode(F.when((F.col("start") < goal) & (goal < end), halves).otherwise(whole)))
    return cut.select("row", "copy", (F.col("p.lo") == F.col("start")).alias("opens"), (F.col("p.hi") - F.col("p.lo")).alias("words"), (F.col("p.hi") / F.col("target")).alias("finish"))


def cut_at(queue: DataFrame, budget: int) -> DataFrame:
    """The packets, in global order of finish, before the running sum of their words reaches the budget; the one that crosses it is cut.

    Packets are range-partitioned and written with their partition. Sums by partition tell which partitions lie within
    the budget as a whole; only the partition in which it is reached is summed up row by row.
    """
    ordered = common.written(queue.repartitionByRange("finish", "row", "copy").withColumn("part", F.spark_partition_id()), "mix-order")
    by_part = ordered.groupBy("part").agg(F.sum("words").alias("n"))
    sums = by_part.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    crossing = sums.where((F.col("begin") < budget) & (F.col("begin") + F.col("n") > budget)).select("part", "begin").first()
    inside = sums.where(F.col("begin") + F.col("n") <= budget).agg(F.max("part")).first()[0]
    taken = ordered.where(F.col("part") <= F.lit(-1 if inside is None else inside)).drop("part")
    if crossing is None:
        return taken
    running = Window.partitionBy("part").orderBy("finish", "row", "copy").rowsBetween(Window.unboundedPreceding, -1)
    last = ordered.where(F.col("part") == crossing.part).withColumn("left", F.lit(budget - crossing.begin) - F.coalesce(F.sum("words").over(running), F.lit(0))).where("left > 0")
    return taken.unionByName(last.withColumn("words", F.least("words", "left")).drop("part", "left"))


def budget_of(targets: DataFrame) -> int:
    """Words of the whole mix: the targets, each rounded down."""
    return targets.agg(F.sum(F.floor("target"))).first()[0] or 0


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Written table source, source_size, weight, target, n_docs of docs(source, size)."""
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    counted = common.written(sizes, "mix-sources")
    targets = fair_targets(cyclic_weights(counted.drop("n_docs"), weights), share, most)
    counts = counted.select(F.col("source").alias("s"), "n_docs")
    out = common.written(targets.join(common.small_side(counts, counted.count()), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    common.drop_written(counted)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and finish (virtual finish time of its first copy) of every row of docs(doc_id, text, source).

    taken counts the words that the mix takes from the row over all copies, those of its packets before the cut of the
    sorted mix at the total budget. Null text has size 0 and is taken 0, as is a text without words; a very long text
    takes part by its size like any other; a null source is a source of its own; rows with equal doc_id are queued next
    to each other and each takes its own share. Extra columns are ignored; an empty table gives no rows.
    """
    sized = common.written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", common.word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    rows = common.written(queued(sized, targets, seed), "mix-queued")
    taken = cut_at(packets(rows, most), budget_of(targets)).groupBy("row").agg(F.sum("words").alias("words"))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), finish.alias("finish"))


def schedule(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: a row of docs for each copy that begins before the cut of the sorted mix at the total budget, globally
    range-sorted by virtual finish time, with the columns of docs.

    A copy that the cut falls into is whole, so a source goes beyond its target by less than one document. Rows without
    words (null, empty, white space) aren't in the mix; a null source is a source of its own. Rows that share an id, or
    all columns, are each there as often as they are taken. Extra columns stay, whatever their names; a very long text is
    a document like any other; an empty table gives no rows.
    """
    # names that columns of docs don't have, and a hash of all columns that tells rows of one id apart
    size, same = "granary_size", "granary_row"
    whole = [F.to_json(c.name) if isinstance(c.dataType, MapType) else F.col(f"`{c.name}`") for c in docs.schema.fields]
    known = docs.withColumns({size: common.word_count(F.col("text")), same: F.xxhash64(*whole)})
    sized = common.written(known.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), "source", F.col(size).alias("size"), same), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    rows = common.written(queued(sized, targets, seed), "mix-queued")
    begun = cut_at(packets(rows, most), budget_of(targets)).where("opens").select("row", "copy")
    finish = (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    placed = begun.join(rows, "row").select(F.col("doc_id").alias("granary_id"), F.col(same).alias("granary_is"), finish.alias("granary_finish"))
    places = common.written(placed, "mix-places")
    again = sized.groupBy("doc_id", same).count().where("count > 1").select(F.col("doc_id").alias("granary_id"), F.col(same).alias("granary_is"))
    repeated = common.written(again, "mix-repeated")
    n_again = repeated.count()
    match = lambda a, b: a["doc_id"].eqNullSafe(b["granary_id"]) & (a[same] == b["granary_is"])
    once = known
    if n_again:  # rows that are alike in all columns: one stands for them in all their places
        side = common.small_side(repeated, n_again)
        alike = known.join(side, match(known, side), "left_semi")
        once = known.join(side, match(known, side), "left_anti").union(alike.dropDuplicates(["doc_id", same]))
    # places grow with the documents, so they are never broadcast, and the plan is the same at every size
    out = once.join(places.hint("merge"), match(once, places))
    return out.repartitionByRange("granary_finish", "doc_id").sortWithinPartitions("granary_finish", "doc_id").select(*docs.columns)
