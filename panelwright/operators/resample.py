"""Training-set rebalancing: interpolated, cleaned, noisy and mixed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.neighbours import distinct_vectors, knn_join
from panelwright.operators.ordering import digest_order, digest_place, row_numbers
from panelwright.session import cut_lineage, fit_rows


def digest_uniform(*key: Column, seed: int = 0) -> Column:
    """Draw from [0, 1) that any engine with MD5 repeats."""
    return digest_place(*key, seed=seed, digits=13).cast("double") / float(1 << 52)


def gaussian(*key: Column, seed: int = 0) -> Column:
    """Reproducible standard normal draw (Box-Muller)."""
    u = F.greatest(digest_uniform(*key, seed=seed), F.lit(1e-300))
    v = digest_uniform(*key, seed=seed + 1_000_003)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def class_sizes(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def interpolate_minority(
    df: DataFrame,
    vector: str,
    label: str,
    identity: str,
    minority: int,
    k: int = 5,
    seed: int = 42,
    target: int | None = None,
) -> DataFrame:
    """Original rows plus synthetic minority rows until the classes balance.

    Each synthetic row lies between a minority row and one of its k nearest minority rows.
    Neighbours come from an exact join over distinct vectors; copies of a vector occupy as
    many of the k places as there are copies.
    """
    sizes = class_sizes(df, label)
    have = sizes.get(minority, 0)
    want = target if target is not None else max(sizes.values())
    k = min(k, have - 1)
    base = df.select(
        F.col(identity).cast("long").alias("sample_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vec"), F.lit(False).alias("synthetic"),
    )
    if k < 1 or want <= have:
        return base
    rows = df.filter(F.col(label) == minority).select(
        F.col(identity).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    )
    points = fit_rows(distinct_vectors(rows, "vec", "id"))
    neighbours = knn_join(points, points, k)
    sized = neighbours.join(points.select(F.col("vid").alias("pid"), F.col("vec").alias("nvec"), "copies"), "pid")
    slots = sized.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "copies", "nvec"))).alias("near")
    )
    # Draws per row: every minority row gets want // have, the first rows one more.
    need = want - have
    ranked = row_numbers(rows.select("id", "vec", digest_place(F.col("id"), seed=seed).alias("_h")), ["_h", "id"], "_r")
    per_row = F.lit(need // have) + (F.col("_r") <= need % have).cast("int")
    draws = (
        ranked.filter(per_row > 0)
        .select("id", "vec", "_r", F.explode(F.sequence(F.lit(1), per_row)).alias("draw"))
        .join(points.select("vec", "vid", F.col("copies").alias("own")), "vec")
        .join(slots, F.col("vid") == F.col("qid"), "left")
    )
    place = F.floor(digest_uniform(F.col("id"), F.col("draw"), seed=seed) * k) + 1 - (F.col("own") - 1)
    reached = F.aggregate(
        F.col("near"),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("array<double>").alias("vec")),
        lambda acc, n: F.struct(
            (acc["seen"] + n["copies"]).alias("seen"),
            F.when(acc["vec"].isNull() & (acc["seen"] + n["copies"] >= place), n["nvec"])
            .otherwise(acc["vec"])
            .alias("vec"),
        ),
    )["vec"]
    other = F.when(place <= 0, F.col("vec")).otherwise(F.coalesce(reached, F.col("vec")))
    u = digest_uniform(F.col("id"), F.col("draw"), seed=seed + 7)
    # Below every id in use, and one for each pair of row and draw.
    lowest = min(0, base.agg(F.min("sample_id")).first()[0] or 0)
    fresh = F.lit(lowest) - ((F.col("draw") - 1) * F.lit(have).cast("long") + F.col("_r"))
    mixed = draws.select(fresh.alias("sample_id"), "vec", other.alias("other"), u.alias("u")).select(
        "sample_id",
        F.lit(minority).alias("label"),
        F.zip_with("vec", "other", lambda a, b: a + F.col("u") * (b - a)).alias("vec"),
        F.lit(True).alias("synthetic"),
    )
    return base.unionByName(mixed)


def edited_neighbours(
    df: DataFrame, vector: str, label: str, identity: str, k: int = 3
) -> DataFrame:
    """Rows whose k nearest rows all carry the row's own label.

    The join runs on distinct vectors with per-label copy counts; a vector present under
    two labels disagrees with itself.
    """
    rows = df.select(
        F.col(identity).cast("long").alias("_id"),
        F.col(label).alias("_label"),
        F.col(vector).cast("array<double>").alias("_vec"),
    )
    labelled = rows.groupBy("_vec").agg(
        F.min("_id").alias("vid"), F.count(F.lit(1)).alias("copies"),
        F.min("_label").alias("low"), F.max("_label").alias("high"),
    )
    points = fit_rows(labelled.select("vid", F.col("_vec").alias("vec"), "copies", "low", "high"))
    near = knn_join(points, points, k).join(
        points.select(F.col("vid").alias("pid"), "copies", "low", "high"), "pid"
    )
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_before", F.coalesce(F.sum("copies").over(w), F.lit(0)))
    own = points.select(F.col("vid").alias("qid"), F.col("copies").alias("own"))
    used = placed.join(own, "qid").filter(F.col("own") - 1 + F.col("_before") < k)
    around = used.groupBy("qid").agg(F.min("low").alias("n_low"), F.max("high").alias("n_high"))
    verdict = points.join(around, F.col("vid") == F.col("qid"), "left").select(
        F.col("vec").alias("_vec"),
        F.when(F.col("copies") > 1, F.least("low", "n_low")).otherwise(F.col("n_low")).alias("_low"),
        F.when(F.col("copies") > 1, F.greatest("high", "n_high")).otherwise(F.col("n_high")).alias("_high"),
    )
    kept = rows.join(verdict, "_vec").filter(
        (F.coalesce("_low", "_label") == F.col("_label"))
        & (F.coalesce("_high", "_label") == F.col("_label"))
    )
    return df.join(kept.select(F.col("_id").alias(identity)), identity, "left_semi")


def balance(
    df: DataFrame, vector: str, label: str, identity: str, minority: int, seed: int = 42
) -> DataFrame:
    """Interpolated minority rows, written once, then neighbour cleaning of both classes."""
    grown = cut_lineage(interpolate_minority(df, vector, label, identity, minority, seed=seed))
    return edited_neighbours(grown, "vec", "label", "sample_id")


def noise_copies(
    df: DataFrame,
    vector: str,
    identity: str,
    copies: int = 5,
    sd: float = 0.05,
    static_from: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``copies`` jittered versions of every row; entries from ``static_from`` on get half the noise."""
    grown = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    # Arrays carry their position so that every entry draws its own noise.
    jittered = F.transform(
        F.col(vector).cast("array<double>"),
        lambda x, i: x
        + F.when(i >= (static_from if static_from is not None else 1 << 30), sd * 0.5).otherwise(sd)
        * gaussian(F.col(identity), F.col("copy"), i, seed=seed),
    )
    return grown.withColumn(vector, jittered)


def beta(a: float, b: float, *key: Column, seed: int = 0, tries: int = 24) -> Column:
    """Reproducible Beta(a, b) draw: the first of ``tries`` pairs of powers of uniform draws whose
    sum is at most one (Johnk's rule). For a and b up to 1, over half of all pairs are accepted."""
    def one(got: Column, i: Column) -> Column:
        x = F.pow(digest_uniform(*key, i, seed=seed), F.lit(1 / a))
        y = F.pow(digest_uniform(*key, i, seed=seed + 1), F.lit(1 / b))
        return F.coalesce(got, F.when((x + y <= 1) & (x + y > 0), x / (x + y)))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.lit(None).cast("double"), one)
    return F.coalesce(found, F.lit(a / (a + b)))


def mixup_pairs(
    df: DataFrame, vector: str, identity: str, factor: int = 2, alpha: float = 0.4, seed: int = 42
) -> DataFrame:
    """``factor`` convex mixes per row with another row of the frame.

    Rows are ranked in a hash order; the r-th row is mixed with the row a drawn distance
    further round the circle, so partners are found by an equi-join on rank.
    """
    place, bucket = digest_order(identity, seed=seed)
    placed = df.select(
        F.col(identity).alias("id"), F.col(vector).cast("array<double>").alias("vec"), place.alias("_h"), bucket.alias("_b"))
    ranked = row_numbers(placed, ["_h", "id"], "_r", bucket=F.col("_b")).select("id", "vec", "_r")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    draws = ranked.select(
        "id", "vec", "_r", F.explode(F.sequence(F.lit(1), F.lit(factor))).alias("draw"),
    ).withColumn("_n", n).filter("_n >= 2")
    hop = F.floor(digest_uniform(F.col("id"), F.col("draw"), seed=seed + 3) * (F.col("_n") - 1)) + 1
    aimed = draws.withColumn("_to", F.pmod(F.col("_r") - 1 + hop, F.col("_n")) + 1)
    partners = ranked.select(F.col("_r").alias("_to"), F.col("vec").alias("other"), F.col("id").alias("partner"))
    weight = beta(alpha, alpha, F.col("id"), F.col("draw"), seed=seed + 11)
    paired = aimed.join(partners, "_to").withColumn("weight", weight)
    return paired.select(
        "id", "draw", "partner", "weight",
        F.zip_with("vec", "other", lambda a, b: F.col("weight") * a + (1 - F.col("weight")) * b).alias("vec"),
    )
