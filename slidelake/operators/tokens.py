"""Token rows: coordinates, masking, augmentation, padding, cosine losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.functions.detrand import digest, digest_uniform, gaussian, u32, uniform
from slidelake.functions.vectors import cosine, let, zeros_like
from slidelake.operators.budget import head_budget
from slidelake.operators.ranking import hash_rank
from slidelake.operators.skew import null_safe_join


def token_mm_xy(df: DataFrame, scale: str = "scale", tile: Column | int = 256) -> DataFrame:
    """Tile centers in millimetres, by the nominal scale."""
    half = (tile if isinstance(tile, Column) else F.lit(tile)) / 2.0
    mm = F.col(scale).cast("double") / 1000.0
    return df.withColumns({"mm_x": (F.col("x") + half) * mm, "mm_y": (F.col("y") + half) * mm})


def mask_positions(
    df: DataFrame, keys: Sequence[str], id_col: str, seed: int, fraction: float = 0.25, feat: str = "feat"
) -> DataFrame:
    """Mark max(1, round(fraction * T)) tokens per bag and zero their vectors.

    Ids alone are ranked.  What comes back to the vectors is one row per bag: the
    last masked position, with which every row decides for itself.
    """
    place = F.struct(u32(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("id"))
    ids = df.select(*keys, id_col, place.alias("__place")).withColumn("__h", F.col("__place.h"))
    ranked = hash_rank(ids, keys, "__h", [id_col])
    m = F.greatest(F.lit(1), F.bround(F.lit(fraction) * F.col("group_rows")))
    last = ranked.where(F.col("rank_no") == m).select(*keys, F.col("__place").alias("__last"))
    out = null_safe_join(df, last, keys, [id_col]).withColumn("masked", place <= F.col("__last")).drop("__last")
    return out.withColumn(feat, F.when(F.col("masked"), zeros_like(feat)).otherwise(F.col(feat)))


def augment_view(feat: str | Column, keys: Sequence, drop_p: float = 0.1, sigma: float = 0.02) -> Column:
    """Element dropout (not rescaled) plus Gaussian noise, seeded by ``keys``.

    One digest per element gives its dropout draw and both normal draws.
    """

    def one(v: Column, i: Column) -> Column:
        def mix(h: Column) -> Column:
            kept = F.when(digest_uniform(h) > drop_p, v).otherwise(F.lit(0.0))
            return kept + F.lit(sigma) * gaussian(digest_uniform(h, 1), digest_uniform(h, 2))

        return let(digest(*keys, i), mix)

    return F.transform((F.col(feat) if isinstance(feat, str) else feat).cast("array<double>"), one)


def augment_bag(
    feat: str,
    bag_keys: Sequence,
    row_keys: Sequence,
    noise_prob: float = 0.4,
    drop_prob: float = 0.3,
    drop_p: float = 0.05,
    sigma: float = 0.01,
) -> Column:
    """Training-bag variant: noise for some bags, then dropout for some bags."""
    flags = F.struct(
        (uniform(*bag_keys, "noise") < noise_prob).alias("noisy"), (uniform(*bag_keys, "drop") < drop_prob).alias("dropped")
    )

    def vector(f: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            def mix(h: Column) -> Column:
                noise = F.lit(sigma) * gaussian(digest_uniform(h, 1), digest_uniform(h, 2))
                noisy = v + F.when(f["noisy"], noise).otherwise(F.lit(0.0))
                return F.when(f["dropped"] & (digest_uniform(h) <= drop_p), F.lit(0.0)).otherwise(noisy)

            return let(digest(*row_keys, i), mix)

        return F.transform(F.col(feat).cast("array<double>"), one)

    return let(flags, vector)


def pad_bags(
    tokens: DataFrame,
    bags: DataFrame,
    bag: str,
    batch: str,
    order: str,
    dim: int,
    budgets: dict[float, int],
    scale: str = "scale",
    feat: str = "feat",
    carry: Sequence[str] = (),
    row_id: str | None = None,
) -> DataFrame:
    """Per bag: token vectors padded with zeros to the longest bag of its batch.

    The tokens are cut to the head of their budget first, which bounds the
    arrays whatever the size of a bag.  Only narrow ids are ranked: the last kept
    place of each (bag, scale) tells a row whether it counts, so the vectors are
    shuffled once, to their bags.  Rows of one ``order`` are told apart by ``row_id``, or else by a hash of what they hold,
    which reads the vectors once more.  A NULL bag is a bag.  The mask is true on padding.  A bag without
    tokens gets one zero vector.  ``carry`` names numeric columns, such as scale
    and coordinates, that are padded with zeros alike.
    """
    zero = F.array_repeat(F.lit(0.0), dim)
    numbers = [F.col(c).cast("double") for c in carry]
    vector = F.col(feat).cast("array<double>")
    tie = F.xxhash64(vector, *numbers) if row_id is None else F.col(row_id)
    placed = tokens.withColumn("__place", F.struct(F.col(order), tie.alias("tie")))
    ids = head_budget(placed.select(bag, scale, "__place"), [bag, scale], budgets, "__place", scale)
    last = ids.groupBy(bag, scale).agg(F.max("__place").alias("__last"))
    kept = null_safe_join(placed, last, [bag, scale], ["__place"]).where(F.col("__place") <= F.col("__last"))
    own = [c.alias(f"__c{i}") for i, c in enumerate(numbers)]
    packed = kept.groupBy(F.struct(bag).alias("__bag")).agg(
        F.array_sort(F.collect_list(F.struct(scale, "__place", vector.alias("__v"), *own))).alias("__t")
    )
    # Rows that even their tie-break leaves equal.
    def head(of: float, most: int) -> Column:
        return F.slice(F.filter("__t", lambda t: t[scale] == of), 1, most)

    packed = packed.withColumn("__t", F.concat(*[head(of, most) for of, most in sorted(budgets.items())]))
    parts = {f"__c{i}": F.coalesce(F.col("__t")[f"__c{i}"], F.array(F.lit(0.0))) for i in range(len(carry))}
    filled = bags.withColumn("__bag", F.struct(bag)).join(packed, "__bag", "left").drop("__bag").withColumns(
        {"tokens": F.coalesce(F.transform("__t", lambda t: t["__v"]), F.array(zero)), **parts}
    )
    longest = filled.groupBy(batch).agg(F.max(F.size("tokens")).alias("t_max"))
    joined = filled.drop("__t").join(longest, batch)
    n = F.size("tokens")
    return joined.select(
        bag,
        batch,
        n.alias("t"),
        "t_max",
        F.concat("tokens", F.array_repeat(zero, F.col("t_max") - n)).alias("tokens"),
        *[F.concat(f"__c{i}", F.array_repeat(F.lit(0.0), F.col("t_max") - n)).alias(c) for i, c in enumerate(carry)],
        F.concat(F.array_repeat(F.lit(False), n), F.array_repeat(F.lit(True), F.col("t_max") - n)).alias("pad_mask"),
    )


def pad_bags_by_scale(
    tokens: DataFrame, bags: DataFrame, bag: str, batch: str, order: str, dim: int, budgets: dict[float, int], scale: str = "scale", **options
) -> DataFrame:
    """``pad_bags`` for each scale of ``budgets`` on its own, each with its own length and mask.

    Rows of other scales raise, as in the budget.
    """
    listed = F.when(F.col(scale).isin(list(budgets)), F.col(scale)).otherwise(
        F.raise_error(F.concat(F.lit("no budget for scale "), F.coalesce(F.col(scale).cast("string"), F.lit("NULL")))).cast("double")
    )
    checked, out = tokens.withColumn(scale, listed), None
    for s, k in budgets.items():
        part = pad_bags(checked.where(F.col(scale) == s), bags, bag, batch, order, dim, {s: k}, scale, **options)
        part = part.withColumn("scale", F.lit(float(s)))
        out = part if out is None else out.unionByName(part)
    return out


def training_batch(
    tokens: DataFrame,
    bags: DataFrame,
    bag: str,
    batch: str,
    order: str,
    dim: int,
    budgets: dict[float, int],
    seed: int,
    mask_fraction: float = 0.25,
    drop_p: float = 0.1,
    sigma: float = 0.02,
    scale: str = "scale",
    feat: str = "feat",
    row_id: str | None = None,
) -> DataFrame:
    """One padded row per bag, as a training step takes it.

    ``view1`` and ``view2`` are two augmentations of the bag's tokens, zero on padding and on the masked places; ``mm_x``, ``mm_y``
    and ``scale`` are padded with zeros; ``pad_mask`` is true on padding; ``mask_index`` lists the max(1, round(mask_fraction * t))
    masked places, ascending.  Tokens are cut and padded by ``pad_bags``, so an array holds no more than the budgets allow, and
    everything behind it is computed within the row: no further shuffle.  Draws are seeded by bag and place.  A bag without tokens
    is one zero vector, which is masked; a NULL bag is a bag.
    """
    placed = token_mm_xy(tokens, scale)
    carry = ["mm_x", "mm_y", scale]
    rows = pad_bags(placed, bags, bag, batch, order, dim, budgets, scale, feat, carry, row_id)
    places = F.transform(
        F.sequence(F.lit(0), F.col("t") - 1), lambda p: F.struct(u32(seed, F.col(bag), p).alias("h"), p.alias("p"))
    )
    m = F.greatest(F.lit(1), F.bround(F.lit(mask_fraction) * F.col("t")).cast("int"))
    masked = F.array_sort(F.transform(F.slice(F.array_sort(places), F.lit(1), m), lambda x: x["p"]))

    def view(which: int) -> Column:
        def one(vector: Column, i: Column) -> Column:
            hidden = (i >= F.col("t")) | F.array_contains("mask_index", i)
            mixed = augment_view(vector, [seed, which, F.col(bag), i], drop_p, sigma)
            return F.when(hidden, F.array_repeat(F.lit(0.0), dim)).otherwise(mixed)

        return F.transform("tokens", one)

    indexed = rows.withColumn("mask_index", masked)
    return indexed.select(
        bag, batch, "t", "t_max", view(1).alias("view1"), view(2).alias("view2"), *carry, "pad_mask", "mask_index"
    )


def cosine_loss(pairs: DataFrame, p: str, z: str, keys: Sequence[str] = (), name: str = "loss") -> DataFrame:
    """Mean of 1 - cos(p, z) over the rows of each group."""
    value = F.avg(F.lit(1.0) - cosine(p, z)).alias(name)
    return pairs.groupBy(*keys).agg(value) if keys else pairs.agg(value)


def two_view_loss(
    pairs: DataFrame, p1: str, z2: str, p2: str, z1: str, masked: str, token_weight: float = 0.5
) -> DataFrame:
    """Symmetric two-view loss over all rows, plus the masked-token term."""
    a, b = 1.0 - cosine(p1, z2), 1.0 - cosine(p2, z1)
    view = 0.5 * F.avg(a) + 0.5 * F.avg(b)
    m = F.col(masked)
    token = 0.5 * F.avg(F.when(m, a)) + 0.5 * F.avg(F.when(m, b))
    return pairs.agg(
        view.alias("loss_view"), token.alias("loss_token"), (view + token_weight * token).alias("loss")
    )
