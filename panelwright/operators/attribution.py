"""Attribution roll-ups, permutation importance and group occlusion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.text import feature_family, feature_group
from panelwright.operators.evaluate import binary_metrics, rank_metrics
from panelwright.operators.ordering import digest_order, digest_place, looked_up, row_numbers
from panelwright.operators.windows import last_rows, share_of_total
from panelwright.session import cut_lineage

EPSILON = 1e-6


def group_table(features: DataFrame, name: str = "feature") -> DataFrame:
    """(feature, group) by the naming rules; ``unmapped`` marks names without a group."""
    group = feature_group(F.col(name))
    return features.select(F.col(name).alias("feature"), group.alias("group")).withColumn(
        "unmapped", F.col("group").rlike("^(UNMAPPED|STATIC)_")
    )


def uncovered(attributions: DataFrame, groups: DataFrame) -> DataFrame:
    """Attributed features that no group holds; must be empty before a roll-up."""
    return attributions.select("feature").distinct().join(groups.select("feature"), "feature", "left_anti")


def roll_up(attributions: DataFrame, groups: DataFrame, entity: str = "case_id") -> DataFrame:
    """Signed and absolute sums, sign and member count per (entity, group)."""
    joined = looked_up(attributions, "feature", groups, "feature", "group", "group").filter(F.col("group").isNotNull())
    summed = joined.groupBy(entity, "group").agg(
        F.sum("value").alias("signed_sum"),
        F.sum(F.abs("value")).alias("abs_sum"),
        F.count(F.lit(1)).alias("members"),
    )
    sign = (
        F.when(F.col("signed_sum") > EPSILON, "+")
        .when(F.col("signed_sum") < -EPSILON, "-")
        .otherwise("mixed")
    )
    return summed.withColumn("sign", sign)


def top_groups(rolled: DataFrame, k: int = 5, entity: str = "case_id") -> DataFrame:
    return last_rows(rolled, entity, [F.desc("abs_sum"), F.asc("group")], k, name="rank")


def family_importance(importance: DataFrame) -> DataFrame:
    """Importance and its share of the total by feature family."""
    summed = importance.groupBy(feature_family(F.col("feature")).alias("family")).agg(
        F.sum("importance").alias("importance")
    )
    return share_of_total(summed, "importance")


def shuffled_partner(
    df: DataFrame, entity: str, features: Sequence[str], repeats: int, seed: int = 42
) -> DataFrame:
    """``df`` once per repeat, with ``repeat`` and the features of another row in ``_other``.

    Rows leave in one hash order and arrive in another, so a repeat deals every row's features
    out exactly once. Both orders are ranked in hash buckets and met by an equi-join: a shuffle
    of any size needs no single task, and rows times repeats is all that crosses the network.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")

    def ranked(rows: DataFrame, salt: int) -> DataFrame:
        place, bucket = digest_order(entity, "repeat", seed=seed + salt)
        placed = rows.withColumns({"_h": place, "_b": bucket})
        return row_numbers(placed, ["_h", entity], "_r", ["repeat"], bucket=F.col("_b")).drop("_h", "_b")

    source = ranked(df.select(entity, *features, every), 0)
    source = source.select("repeat", "_r", F.struct(*features).alias("_other"))
    return ranked(df.select("*", every), 1).join(source, ["repeat", "_r"]).drop("_r")


def shuffled_column(
    df: DataFrame, entity: str, features: Sequence[str], repeats: int, seed: int = 42
) -> DataFrame:
    """(feature, repeat, entity, new_value): each feature's values dealt to other entities."""
    values = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col("_other")[f].cast("double").alias("new_value")) for f in features
    ])
    dealt = shuffled_partner(df, entity, features, repeats, seed)
    return dealt.select("repeat", entity, F.inline(values)).select("feature", "repeat", entity, "new_value")


def permutation_importance(
    df: DataFrame,
    entity: str,
    label: str,
    features: Sequence[str],
    scorer: Callable[[DataFrame], DataFrame],
    repeats: int = 10,
    threshold: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Mean / sd AUC drop and mean F1 drop per feature, over shuffles across entities.

    ``scorer`` adds a ``probability`` column. A repeat deals out whole rows once; each feature
    in turn takes its dealt value inside the task, and all are scored as one long table.
    """
    dealt = shuffled_partner(df, entity, features, repeats, seed)
    permuted = dealt.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    permuted = permuted.withColumns({
        f: F.when(F.col("feature") == f, F.col("_other")[f]).otherwise(F.col(f)) for f in features
    })
    keys = ["feature", "repeat"]
    scored = scorer(permuted.drop("_other"))
    base = scorer(df)
    base_auc = rank_metrics(base, label, "probability").select("roc_auc").scalar()
    base_f1 = binary_metrics(base, label, "probability", threshold).select("f1").scalar()
    auc = rank_metrics(scored, label, "probability", keys)
    f1 = binary_metrics(scored, label, "probability", threshold, keys).select(*keys, "f1")
    drops = auc.join(f1, keys).select(
        "feature", (base_auc - F.col("roc_auc")).alias("auc_drop"), (base_f1 - F.col("f1")).alias("f1_drop")
    )
    return drops.groupBy("feature").agg(
        F.avg("auc_drop").alias("auc_drop_mean"),
        F.stddev_pop("auc_drop").alias("auc_drop_std"),
        F.avg("f1_drop").alias("f1_drop_mean"),
    )


def trajectory_partners(entities: DataFrame, entity: str, repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, entity, partner): each repeat deals every entity the next one in a drawn order.

    The order follows MD5 digests of entity, repeat and seed; no entity is its own partner
    unless it is alone.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    drawn = entities.select(entity).distinct().select(entity, every)
    place = digest_place(F.col(entity), F.col("repeat"), seed=seed)
    ranked = row_numbers(drawn.withColumn("_h", place), ["_h", entity], "_r", ["repeat"], size="_n").drop("_h")
    giver = ranked.select("repeat", F.col("_r").alias("_give"), F.col(entity).alias("partner"))
    taker = ranked.withColumn("_give", F.col("_r") % F.col("_n") + 1)
    return taker.join(giver, ["repeat", "_give"]).select("repeat", entity, "partner")


def trajectory_importance(
    panel: DataFrame, entity: str, step: str, groups: Mapping[str, Sequence[str]], labels: DataFrame, label: str,
    scorer: Callable[[DataFrame], DataFrame], repeats: int = 10, threshold: float = 0.5, seed: int = 42,
) -> DataFrame:
    """(group, auc_drop_mean, auc_drop_std, f1_drop_mean): what a model loses without a group's courses.

    In a repeat an entity takes its partner's values of one feature group at all steps and in
    all columns of the group at once, so a course stays a course and columns that move
    together stay together; steps that the partner lacks become gaps. ``panel`` should hold
    entities that the model hasn't seen. ``scorer`` gets panels whose entity column names
    entity, repeat and group, and returns one ``probability`` per such unit. Every panel row
    crosses the network once a repeat; groups are taken in turn after that, in the task.
    """
    columns = sorted({c for own in groups.values() for c in own})
    partners = trajectory_partners(panel, entity, repeats, seed)
    other = panel.select(F.col(entity).alias("partner"), step, F.struct(*columns).alias("_other"))
    dealt = panel.join(partners, entity).join(other, ["partner", step], "left").drop("partner")
    long = dealt.withColumn("_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    long = long.withColumns({
        c: F.when(F.col("_group").isin(*[g for g, own in groups.items() if c in own]), F.col("_other")[c]).otherwise(F.col(c))
        for c in columns
    }).drop("_other")
    plain = panel.withColumns({"repeat": F.lit(-1), "_group": F.lit("")})
    every = long.unionByName(plain)
    unit = F.concat_ws("|", F.col("repeat").cast("string"), F.col("_group"), F.col(entity).cast("string"))
    units = every.withColumn(entity, unit).drop("repeat", "_group")
    parts = F.split(F.col(entity), "\\|", 3)
    kind = labels.schema[entity].dataType
    scored = scorer(units).select(
        parts[0].cast("int").alias("repeat"), parts[1].alias("group"), parts[2].cast(kind).alias(entity), "probability")
    scored = cut_lineage(scored.join(labels.select(entity, F.col(label).alias("_y")), entity))
    keys = ["group", "repeat"]
    auc = rank_metrics(scored, "_y", "probability", keys)
    f1 = binary_metrics(scored, "_y", "probability", threshold, keys).select(*keys, "f1")
    both = auc.join(f1, keys).select(*keys, "roc_auc", "f1")
    base = both.filter("repeat = -1")
    drops = both.filter("repeat >= 0").select(
        "group", (base.select("roc_auc").scalar() - F.col("roc_auc")).alias("auc_drop"),
        (base.select("f1").scalar() - F.col("f1")).alias("f1_drop"))
    return drops.groupBy("group").agg(
        F.avg("auc_drop").alias("auc_drop_mean"), F.stddev_pop("auc_drop").alias("auc_drop_std"), F.avg("f1_drop").alias("f1_drop_mean"))


def occlusion(
    df: DataFrame,
    entity: str,
    groups: Mapping[str, Sequence[str]],
    scorer: Callable[[DataFrame], DataFrame],
    baselines: Mapping[str, float] | None = None,
) -> DataFrame:
    """(entity, group, delta, direction): score change when a group's members are masked.

    Members go to their baseline (0 on scaled inputs, raw 1 for missing flags as given by
    ``baselines``). Rows are multiplied by the fixed number of groups inside the scan stage
    and scored once; a null group is the unmasked row.
    """
    baselines = baselines or {}
    names = [g for g, members in groups.items() if any(m in df.columns for m in members)]
    wide = df.withColumn("_group", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(g) for g in names])))
    touched: dict[str, list[str]] = {}
    for g in names:
        for m in groups[g]:
            if m in df.columns:
                touched.setdefault(m, []).append(g)
    masked: dict[str, Column] = {
        m: F.when(F.col("_group").isin(*owners), F.lit(float(baselines.get(m, 0.0)))).otherwise(F.col(m))
        for m, owners in touched.items()
    }
    scored = scorer(wide.withColumns(masked)).select(entity, "_group", "probability")
    gathered = scored.groupBy(entity).agg(
        F.max(F.when(F.col("_group").isNull(), F.col("probability"))).alias("_base"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("_group").isNotNull(), F.struct("_group", "probability")))
        ).alias("_scores"),
    )
    rows = gathered.select(entity, "_base", F.explode("_scores").alias("group", "_p"))
    raw = F.col("_base") - F.col("_p")
    return rows.select(
        entity, "group", F.abs(raw).alias("delta"),
        F.when(raw >= 0, "risk").otherwise("protective").alias("direction"),
    )
