"""Models against the ceiling: predictions, metrics, fractions of what noise leaves attainable, comparisons with a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clip, fraction_of_ceiling, ratio
from ..functions.stored import kept
from .order import ranks

KEYS = ("task", "split", "seed", "model")


def tested(parts: DataFrame, groups: dict[str, str | None], keep: tuple[str, ...] = ()) -> DataFrame:
    """The test entities of every (split, seed): task, split, seed, mol_id, y, n_docs, y_train_mean, the columns to keep, and preds, an
    array of (model, pred): the train mean of each model's group; entities of an unseen group get the mean of all. parts: task,
    split, seed, mol_id, y, n_docs, part and the groups' columns. Means of all models come in one pass and are written: entities
    stay where they are while the means are few."""
    run = ["task", "split", "seed"]
    own = {m: F.lit("") if g is None else F.col(g).cast("string") for m, g in groups.items()}
    models = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), g.alias("group")) for m, g in own.items()]))
    train = parts.where("part = 'train'").select(*run, "y", models)
    means = kept(train.groupBy(*run, "model", "group").agg(F.avg("y").alias("group_mean"), F.sum("y").alias("total"), F.count("y").alias("known")), "means")
    every = kept(means.where(F.col("model") == next(iter(groups))).groupBy(*run).agg((F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("y_train_mean")), "means")
    out = parts.where("part = 'test'").select(*run, "mol_id", "y", "n_docs", *keep, *[g.alias(f"__g{i}") for i, g in enumerate(own.values())]).join(every, run)
    for i, m in enumerate(groups):
        out = out.join(means.where(F.col("model") == m).select(*run, F.col("group").alias(f"__g{i}"), F.col("group_mean").alias(f"__m{i}")), [*run, f"__g{i}"], "left")
    preds = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(f"__m{i}", "y_train_mean").alias("pred")) for i, m in enumerate(groups)])
    return out.select(*run, "mol_id", "y", "n_docs", "y_train_mean", *keep, preds.alias("preds"))


def group_mean_predictions(parts: DataFrame, groups: dict[str, str | None]) -> DataFrame:
    """:func:`tested` with a row for each model: task, split, seed, model, mol_id, y, pred, n_docs, y_train_mean."""
    rows = tested(parts, groups).select("task", "split", "seed", "mol_id", "y", "n_docs", "y_train_mean", F.inline("preds"))
    return rows.select(*KEYS, "mol_id", "y", "pred", "n_docs", "y_train_mean")


def completed(predictions: DataFrame, entities: DataFrame, parts: DataFrame) -> DataFrame:
    """Predictions with y, n_docs and the train mean filled in from the entities and the splits."""
    mean = kept(parts.where("part = 'train'").groupBy("task", "split", "seed").agg(F.avg("y").alias("y_train_mean")), "means")
    facts = entities.select("task", "mol_id", "y", "n_docs")
    return predictions.select("task", "split", "seed", "model", "mol_id", "pred").join(facts, ["task", "mol_id"], "left").join(mean, ["task", "split", "seed"], "left")


def _judged(p: DataFrame, stored: bool, *terms: str) -> DataFrame:
    """The metrics of each run and, by name, the means of terms of its rows.

    One sort ranks y. Rows of one prediction then count together: a group's mean is the prediction of many, so that predictions are
    ranked by their counts; where each row has its own, there are as many cells as rows."""
    ranked = ranks(p.select(*KEYS, "y", "pred", *terms), KEYS, {"ry": "y"}, stored)
    # one zero and one NaN, as groups have them
    error, known = F.col("y") - F.col("pred"), F.col("pred").isNotNull() & ~F.isnan("pred")
    ry = F.when(known, F.col("ry"))
    cells = ranked.groupBy(*KEYS, "pred").agg(
        F.count(F.lit(1)).alias("n"), F.count(error).alias("ne"), F.sum(error * error).alias("e2"), F.sum(F.abs(error)).alias("e1"),
        F.count("y").alias("ny"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"), F.min("y").alias("low"), F.max("y").alias("high"),
        F.count(ry).alias("nr"), F.sum(ry).alias("r1"), F.sum(ry * ry).alias("r2"), F.min(ry).alias("rlow"), F.max(ry).alias("rhigh"),
        *[x for t in terms for x in (F.sum(t).alias(f"sum_{t}"), F.count(t).alias(f"n_{t}"))],
    )
    whole = Window.partitionBy(*KEYS)
    # a prediction's place counts all rows that have one, also those without a y
    upto = F.sum(F.when(known, F.col("n"))).over(whole.orderBy(F.when(known, F.col("pred")).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumns({"rp": F.when(known, upto - (F.col("n") - 1) / F.lit(2.0)), "all": F.sum(F.col("ny") * F.col("mean")).over(whole) / F.sum("ny").over(whole)})
    spread = F.col("ny") * (F.col("var") + (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all")))
    out = cells.groupBy(*KEYS).agg(
        F.sum("n").alias("n_test"), (F.sum("e2") / F.sum("ne")).alias("mse"), (F.sum("e1") / F.sum("ne")).alias("mae"),
        F.min("low").alias("low"), F.max("high").alias("high"), (F.sum(spread) / F.sum("ny")).alias("var"),
        F.sum("nr").alias("m"), F.sum("r1").alias("a"), F.sum("r2").alias("aa"), F.sum(F.col("rp") * F.col("nr")).alias("b"), F.sum(F.col("rp") * F.col("rp") * F.col("nr")).alias("bb"),
        F.sum(F.col("rp") * F.col("r1")).alias("ab"), (F.max("rhigh") > F.min("rlow")).alias("ry_differ"), (F.max(F.when(F.col("nr") > 0, F.col("rp"))) > F.min(F.when(F.col("nr") > 0, F.col("rp")))).alias("rp_differ"),
        *[(F.sum(f"sum_{t}") / F.nullif(F.sum(f"n_{t}"), F.lit(0))).alias(f"mean_{t}") for t in terms],
    )
    m, a, b = F.col("m"), F.col("a"), F.col("b")
    rho = (F.col("ab") - a * b / m) / F.sqrt((F.col("aa") - a * a / m) * (F.col("bb") - b * b / m))
    return out.select(
        *KEYS, "n_test", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("high") > F.col("low"), 1 - F.col("mse") / F.col("var")).alias("r2"),
        F.when(F.col("ry_differ") & F.col("rp_differ"), rho).alias("spearman"), *[f"mean_{t}" for t in terms],
    )


def metrics(p: DataFrame, stored: bool = False) -> DataFrame:
    """rmse, mae, r2 (population variance; null without any) and Spearman's rho of each run."""
    return _judged(p, stored)


def benchmark(p: DataFrame, parts: DataFrame, stored: bool = False) -> DataFrame:
    """A row for each run: metrics, the error of the train mean on the same rows, label noise of the test, sizes."""
    base = F.col("y") - F.col("y_train_mean")
    own = _judged(p.withColumns({"base": base * base, "inv": 1 / F.col("n_docs")}), stored, "base", "inv")
    size = parts.groupBy("task", "split", "seed").agg(F.count_if(F.col("part") == "train").alias("n_train"))
    out = own.join(size, ["task", "split", "seed"])
    return out.select(*KEYS, "n_test", "rmse", "mae", "r2", "spearman", F.sqrt("mean_base").alias("rmse_mean"), F.col("mean_inv").alias("test_mean_inv_ndocs"), "n_train")


def add_ceiling(b: DataFrame, c: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """benchmark rows with their task's ceiling and the fractions of it; tasks without a ceiling go. With bounds (task, sigma_lo,
    sigma_hi), also the fraction at either end of the noise's interval."""
    out = b.join(c.select("task", "sigma", "var_y"), "task").withColumn("floor", F.col("sigma") * F.sqrt("test_mean_inv_ndocs"))
    out = out.withColumn("r2_max", F.greatest(F.lit(0.0), 1 - ratio(F.col("floor") * F.col("floor"), "var_y")))
    true = {k: F.sqrt(F.greatest(F.lit(0.0), F.col(k) * F.col(k) - F.col("floor") * F.col("floor"))) for k in ("rmse", "rmse_mean")}
    known = F.col("floor").isNotNull()
    ends = []
    if bounds is not None:
        out = out.join(bounds.select("task", "sigma_lo", "sigma_hi"), "task", "left")
        ends = [fraction_of_ceiling("rmse", "rmse_mean", F.col(f"sigma_{x}") * F.sqrt("test_mean_inv_ndocs")).alias(f"frac_ceiling_at_sigma_{x}") for x in ("lo", "hi")]
    return out.select(
        *b.columns, "sigma", "var_y", F.col("floor").alias("rmse_floor"), F.when(known, F.col("r2_max")).alias("r2_max"),
        fraction_of_ceiling("rmse", "rmse_mean", "floor").alias("frac_ceiling"), ratio("floor", "rmse").alias("frac_rmse"), ratio("r2", F.when(known, F.col("r2_max"))).alias("frac_r2"),
        F.when(known, 1 - ratio(true["rmse"], true["rmse_mean"])).alias("frac_ceiling_true"), F.coalesce(F.col("rmse") < F.col("floor"), F.lit(False)).alias("below_floor"),
        ratio(F.col("rmse_mean") - F.col("floor"), "rmse_mean").alias("headroom"),
        F.coalesce(ratio(F.col("rmse_mean") - F.col("floor"), "rmse_mean") < 0.2, F.lit(False)).alias("low_headroom"),
        *ends,
    )


MEANS = ("rmse", "mae", "r2", "spearman", "rmse_mean", "frac_ceiling", "frac_rmse")


def _means(rows: DataFrame) -> list[str]:
    return [*MEANS, *[c for c in ("frac_ceiling_at_sigma_lo", "frac_ceiling_at_sigma_hi") if c in rows.columns]]


def per_task(rows: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """Means over seeds; with pooled (task, split, model, frac_pooled, frac_lo, frac_hi), the interval over entities beside them."""
    out = rows.groupBy("task", "split", "model").agg(*[F.avg(c).alias(c) for c in _means(rows)], F.sum("n_test").alias("n_test_rows"))
    if pooled is None:
        return out
    names = {"frac_pooled": "frac_ceiling_pooled", "frac_lo": "frac_ceiling_lo", "frac_hi": "frac_ceiling_hi"}
    return out.join(pooled.select("task", "split", "model", *[F.col(a).alias(b) for a, b in names.items()]), ["task", "split", "model"], "left")


def leaderboard(tasks: DataFrame) -> DataFrame:
    """Equal weight to each task; the place is by fraction of the ceiling."""
    out = tasks.groupBy("split", "model").agg(F.count_distinct("task").alias("n_tasks"), *[F.avg(c).alias(c) for c in _means(tasks)])
    return out.withColumn("place", F.rank().over(Window.partitionBy("split").orderBy(F.round("frac_ceiling", 9).desc_nulls_last())))


def paired(tasks: DataFrame, baseline: str) -> DataFrame:
    """Differences from the baseline on the tasks that both have."""
    base = tasks.where(F.col("model") == baseline).select("task", "split", F.col("frac_ceiling").alias("base_frac"), F.col("rmse").alias("base_rmse"))
    rows = tasks.where(F.col("model") != baseline).join(base, ["task", "split"]).withColumns({"d": F.col("frac_ceiling") - F.col("base_frac"), "dr": F.col("rmse") - F.col("base_rmse")})
    return rows.groupBy("split", "model").agg(
        F.count("d").alias("n_tasks"), F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.5)).alias("median_diff"), F.count_if(F.col("d") > 0).alias("n_better"), F.avg("dr").alias("mean_diff_rmse")
    )


def common_rows(p: DataFrame) -> DataFrame:
    """Predictions of the (seed, entity) that every model of the task and split has."""
    models = kept(p.groupBy("task", "split").agg(F.count_distinct("model").alias("__m")), "models")
    own = F.size(F.collect_set("model").over(Window.partitionBy("task", "split", "seed", "mol_id")))
    return p.withColumn("__k", own).join(models, ["task", "split"]).where("__k = __m").select(*p.columns)


def fraction_over(p: DataFrame, c: DataFrame) -> DataFrame:
    """Fraction of the ceiling pooled over common rows, all models sharing floor and train-mean error."""
    error, base = F.col("y") - F.col("pred"), F.col("y") - F.col("y_train_mean")
    sums = common_rows(p).groupBy("task", "split", "model").agg(
        F.count(F.lit(1)).alias("n_common_rows"), F.sqrt(F.avg(error * error)).alias("rmse"), F.sqrt(F.avg(base * base)).alias("rmse_mean"), F.avg(1 / F.col("n_docs")).alias("inv"),
    )
    sums = sums.join(c.select("task", "sigma"), "task").withColumn("floor", F.col("sigma") * F.sqrt("inv"))
    return sums.select("task", "split", "model", "n_common_rows", fraction_of_ceiling("rmse", "rmse_mean", "floor").alias("frac_ceiling"))


def pair_metrics(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """Of pairs (task, split, seed, a, b) of entities: how often a model has the sign of their difference right, and the error of it."""
    a = p.select(*KEYS, F.col("mol_id").alias("a"), F.col("y").alias("ya"), F.col("pred").alias("pa"))
    b = p.select(*KEYS, F.col("mol_id").alias("b"), F.col("y").alias("yb"), F.col("pred").alias("pb"))
    rows = pairs.select("task", "split", "seed", "a", "b").join(a, ["task", "split", "seed", "a"]).join(b, [*KEYS, "b"])
    dy, dp = F.col("ya") - F.col("yb"), F.col("pa") - F.col("pb")
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.when(F.signum(dy) == F.signum(dp), 1.0).otherwise(0.0)).alias("sign_acc"), F.sqrt(F.avg((dy - dp) * (dy - dp))).alias("rmse_delta")
    )


def attenuation(rows: DataFrame) -> DataFrame:
    """Reliability of the labels and what R² and rho would be without their noise."""
    rel = clip(1 - ratio(F.col("rmse_floor") * F.col("rmse_floor"), "var_y"), 0.0, 1.0)
    out = rows.withColumn("reliability", rel)
    return out.select("task", "split", "seed", "model", "reliability", ratio("r2", "reliability").alias("r2_true"), F.when(F.col("reliability") > 0, F.col("spearman") / F.sqrt("reliability")).alias("rho_true"))
