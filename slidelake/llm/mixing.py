"""Mix sources to target weights with a low-discrepancy slot schedule.

Every source is a stream: its documents in the order of a seeded hash, cut into blocks of ``block_words`` words.  Slot
``n`` of the schedule has the golden-ratio point ``n * GOLDEN mod 2**32``; the cumulative needs of the sources map the
point to a source.  The slots of a source are ranked, and slot ``r`` takes block ``r mod blocks`` in pass
``r div blocks``.  Slots beyond a source's need are cut, the few that the schedule leaves short are appended, and the
last slot of a source ends where its target is met, so a source misses its target by rounding alone.

Defined results: a null text has size 0; a document without words is never taken; a null source is a source of its own
and comes last; repeated rows are taken separately, each at its own place in the stream; an empty table gives an empty
mix.  Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.operators.ranking import exact_rank, running_sums, slab_rank
from slidelake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: 2**32 times the golden ratio, made odd: its multiples mod 2**32 visit every point once.
GOLDEN = 2654435769
POINTS = 2**32
HALF = 2**16
#: Slots are matched to sources by the upper bits of their points.
BUCKET_BITS = 16
SLAB_SLOTS = 100_000
SLAB_DOCS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Give ``sources`` (source, source_size) the weights in turn, by code point, null last; adds ``sid`` from 1."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = exact_rank(sources, [], order, "sid").drop("group_rows")
    at = (F.col("sid") - 1) % len(weights) + 1
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), at.cast("int")))


def mix_targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Share the words of all sources by ``weight``; no target exceeds ``most`` times its source's size.

    What a stopped source leaves is shared again by weight until none is above.  The loop carries two sums; the stopped
    sources only grow in number, so it ends.
    """
    room = F.col("source_size") * most
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    stopped_words = stopped_weight = 0
    while True:
        left = (weights or 0) - stopped_weight
        share = (total - stopped_words) / left if left > 0 else 0.0
        above = F.col("weight") * F.lit(share) > room
        words, weight = sources.agg(F.sum(F.when(above, room)), F.sum(F.when(above, F.col("weight")))).first()
        if (weight or 0) == stopped_weight:
            break
        stopped_words, stopped_weight = words, weight
    target = F.when(above, room.cast("double")).otherwise(F.col("weight") * F.lit(share))
    return sources.withColumn("target", target)


def _needs(targets: DataFrame, block_words: int, most: int) -> DataFrame:
    """Words and slots that each source gives: ``passes`` whole passes and ``rest`` words of one more."""
    words = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most)
    size = F.greatest(F.col("source_size"), F.lit(1))
    return (
        targets.withColumn("words", words)
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("passes", F.expr("words div greatest(source_size, 1)"))
        .withColumn("rest", F.col("words") % size)
        .withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
    )


def slot_schedule(needs: DataFrame) -> DataFrame:
    """(slot, sid, rank): which source fills each slot, and the slot's rank from 0 among the source's slots."""
    spark = needs.sparkSession
    n = needs.agg(F.sum("need")).first()[0] or 0
    edges = running_sums(needs.select("sid", "need"), [], [F.col("sid")], {"need": "cum"})
    edge = lambda c: F.floor(c * F.lit(float(POINTS)) / F.lit(float(max(n, 1)))).cast("long")
    spans = edges.select("sid", "need", edge(F.col("cum_run") - F.col("need")).alias("lo"), edge(F.col("cum_run")).alias("hi"))
    spans = materialize(spans, "spans")
    by_bucket = spans.where("hi > lo").withColumn(
        "bucket", F.explode(F.sequence(F.shiftright("lo", BUCKET_BITS), F.shiftright(F.col("hi") - 1, BUCKET_BITS)))
    )
    # In halves of the slot number: the product of two whole ones would not fit.
    low, high = F.col("slot") % HALF, F.expr(f"slot div {HALF}") % HALF
    point = (low * GOLDEN + high * GOLDEN % HALF * HALF) % POINTS
    slots = (
        spark.range(0, n, 1, max(1, n // SLAB_SLOTS))
        .withColumnRenamed("id", "slot")
        .withColumn("point", point)
        .withColumn("bucket", F.shiftright("point", BUCKET_BITS))
    )
    placed = slots.join(by_bucket, "bucket").where("point >= lo and point < hi").select("slot", "sid", "need")
    ranked = slab_rank(placed, ["sid"], F.expr(f"slot div {SLAB_SLOTS}"), [F.col("slot")], "rank")
    ranked = ranked.withColumn("rank", F.col("rank").cast("long") - 1)
    # The schedule misses a need by the sequence's discrepancy: a few slots.
    met = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("met"))
    short = (
        spans.join(met, "sid", "left")
        .withColumn("met", F.coalesce("met", F.lit(0)))
        .where("met < need")
        .withColumn("rank", F.explode(F.expr("sequence(met, need - 1)")))
        .select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    )
    return ranked.where("rank < need").select("slot", "sid", "rank").unionByName(short)


def source_streams(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Shuffle each source's documents and place them: adds ``sid`` and ``start``, the words before the document."""
    rows = sizes.count()
    slabs = max(1, rows // SLAB_DOCS)
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sizes.join(sources.select("source", "sid"), sizes["source"].eqNullSafe(sources["source"])).select(
        sizes["*"], "sid", key.alias("key")
    )
    slab = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slabs / POINTS)
    placed = running_sums(keyed, ["sid"], [F.col("key"), F.col("doc_id"), F.col("size")], {"size": "pos"}, slab)
    return placed.select(*sizes.columns, "sid", (F.col("pos_run") - F.col("size")).alias("start"))


def mix(streams: DataFrame, needs: DataFrame, block_words: int) -> DataFrame:
    """The mix in order of ``slot``: which words of which document each slot takes.

    Columns sid, start and doc_id name the document, ``from_word`` and ``n_words`` its part in the slot.
    """
    end = F.col("start") + F.col("size")
    pieces = (
        streams.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
        .withColumn("from", F.greatest(F.col("start"), F.col("block") * block_words))
        .withColumn("to", F.least(end, (F.col("block") + 1) * block_words))
    )
    slots = (
        slot_schedule(needs)
        .join(needs.select("sid", "blocks", "passes", "rest", "source_size"), "sid")
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("stop", F.when(F.expr("rank div blocks") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest")))
    )
    words = F.least("to", "stop") - F.col("from")
    return (
        pieces.join(slots.select("slot", "sid", "block", "stop"), ["sid", "block"])
        .withColumn("n_words", words)
        .where("n_words > 0")
        .select("slot", "sid", "start", "doc_id", (F.col("from") - F.col("start")).alias("from_word"), "n_words")
    )


def mixed_documents(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    block_words: int = 4096,
    seed: int = 42,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``documents``: its size, its source's size and target, and the words the mix takes of it.

    ``first_slot`` is the slot in which the mix first takes of the document (null: never): in its order, the sources come as
    evenly as the schedule has them.  The columns in ``keep`` come too.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    sizes = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *kept), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    needs = materialize(_needs(mix_targets(cycled_weights(sources, weights), most), block_words, most), "needs")
    streams = materialize(source_streams(sizes, needs, seed), "streams")
    taken = mix(streams, needs, block_words).groupBy("sid", "start").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    # Only documents with words are looked up: one without shares its start with the next.
    rows = streams.join(needs.select("sid", "source_size", "target"), "sid")
    place = F.when(F.col("size") > 0, F.col("start")).alias("place")
    return (
        rows.select("*", place)
        .join(taken.select(F.col("sid").alias("t_sid"), F.col("start").alias("t_start"), "taken", "first_slot"), (F.col("sid") == F.col("t_sid")) & (F.col("place") == F.col("t_start")), "left")
        .select(
            "doc_id",
            "source",
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            "first_slot",
        )
    )
