"""Removal of entities that a reference registry holds, exactly or nearly, with a log of what each step costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import share
from . import similarity
from .order import quantiles

STEPS = ("exact_full", "exact_short", "near")


def keyed(data: DataFrame, key: str) -> DataFrame:
    """data whose rows all have a short key: one that has none is known by its id, so that no two such rows are one entity."""
    return data.withColumn("key_short", F.coalesce("key_short", F.col(key).cast("string")))


def flags(data: DataFrame, registry: DataFrame) -> DataFrame:
    """data with exact_full, exact_short and the registry's sources of the short key."""
    full = registry.select("key_full").distinct().withColumn("exact_full", F.lit(True))
    short = registry.where("key_short IS NOT NULL").groupBy("key_short").agg(F.array_sort(F.collect_set("source")).alias("exact_sources"))
    out = data.join(full, "key_full", "left").join(short, "key_short", "left")
    return out.withColumn("exact_full", F.coalesce("exact_full", F.lit(False))).withColumn("exact_short", F.col("exact_sources").isNotNull())


def annotate(data: DataFrame, registry: DataFrame, per_mille: int = 800, key: str = "doc_id", k: int = 5) -> DataFrame:
    """flags, and near: an entity without an exact match whose similarity to some registry row is above per_mille / 1000. Registry rows
    stand for one only where their words are the same in the same order: a short key says nothing of order, and so not of shingles."""
    marked = flags(data, registry)
    left = similarity.rows(marked.where("NOT exact_short AND NOT exact_full"), key, k=k)
    sequence = F.md5(F.array_join("words", "\u0001", "")).alias("sequence")
    right = similarity.rows(registry.select(sequence, "words").where("sequence IS NOT NULL").dropDuplicates(["sequence"]), "sequence", k=k)
    near = similarity.similar_rows(left, right, key, "sequence", per_mille, inclusive=False, k=k).select(key).distinct().withColumn("near", F.lit(True))
    return marked.join(near, key, "left").withColumn("near", F.coalesce("near", F.lit(False)))


def first_step(annotated: DataFrame) -> DataFrame:
    """annotated with the step that removes each entity, null for those that stay."""
    step = F.when(F.col("exact_full"), "exact_full").when(F.col("exact_short"), "exact_short").when(F.col("near"), "near")
    return annotated.withColumn("step", step)


def funnel(annotated: DataFrame, by: str) -> DataFrame:
    """removed and left after each step, for each value of ``by``; steps that remove nothing have their row."""
    one = first_step(annotated).groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("step") == s).alias(s) for s in STEPS])
    steps = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(s).alias("step"), F.col(s).alias("removed")) for k, s in enumerate(STEPS, 1)])
    rows = one.select(by, "total", F.explode(F.array_insert(steps, 1, F.struct(F.lit(0).alias("step_no"), F.lit("raw").alias("step"), F.lit(0).cast("long").alias("removed")))).alias("s")).select(by, "total", "s.*")
    gone = F.sum("removed").over(Window.partitionBy(by).orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(by, "step_no", "step", "removed", (F.col("total") - gone).alias("left"))


def loss_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("step").agg(F.sum("removed").alias("removed"))


def last_step(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.max_by("left", "step_no").alias("left"), F.max_by("step", "step_no").alias("step"))


def loss_pivot(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).pivot("step", ["raw", *STEPS]).agg(F.sum("removed"))


def cleaned(data: DataFrame, annotated: DataFrame) -> DataFrame:
    """data without what any step removes."""
    return data.join(first_step(annotated).where("step IS NOT NULL").select("doc_id"), "doc_id", "left_anti")


def after_year(m: DataFrame, year: int) -> DataFrame:
    """Measurements strictly after the year; a null year is not after it."""
    return m.where(F.col("year") > year)


def loss_log(m: DataFrame, annotated: DataFrame, year: int | None = None) -> DataFrame:
    """(task, step_no, step, mols_removed, meas_removed, mols_left, meas_left): what each step costs a task in entities and measurements,
    the raw state first. annotated: mol_id with the flags of :func:`annotate`. The year step keeps measurements strictly after the
    year and the entities that still have any."""
    steps = ["raw", *STEPS] + ([f"year>{year}"] if year is not None else [])
    marked = m.where("mol_id IS NOT NULL").join(first_step(annotated).select("mol_id", "step"), "mol_id", "left")
    # an entity's measurements, and those after the year: an entity goes at one step
    mols = marked.groupBy("task", "mol_id").agg(F.first("step").alias("step"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("year") > (year or 0)).alias("late"))
    at = F.coalesce(F.array_position(F.array(*map(F.lit, steps)), F.col("step")).cast("int") - 1, F.lit(len(STEPS) + 1))
    sums = mols.withColumn("at", at).groupBy("task", "at").agg(
        F.count(F.lit(1)).alias("mols"), F.sum("n").alias("meas"), F.count_if(F.col("late") > 0).alias("late_mols"), F.sum("late").alias("late_meas")
    )
    last = len(STEPS) + 1
    one = sums.groupBy("task").agg(
        F.sum("mols").alias("mols"), F.sum("meas").alias("meas"),
        *[F.coalesce(F.sum(F.when(F.col("at") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in range(1, last) for c in ("mols", "meas")],
        *[F.coalesce(F.sum(F.when(F.col("at") == last, F.col(c) - F.col(f"late_{c}"))), F.lit(0)).alias(f"{c}{last}") for c in ("mols", "meas")],
    )
    rows = [F.struct(F.lit(0).alias("step_no"), F.lit("raw").alias("step"), F.lit(0).cast("long").alias("mols_removed"), F.lit(0).cast("long").alias("meas_removed"))]
    rows += [F.struct(F.lit(k).alias("step_no"), F.lit(s).alias("step"), F.col(f"mols{k}").alias("mols_removed"), F.col(f"meas{k}").alias("meas_removed")) for k, s in enumerate(steps) if k]
    out = one.select("task", "mols", "meas", F.explode(F.array(*rows)).alias("s")).select("task", "mols", "meas", "s.*")
    w = Window.partitionBy("task").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    left = [(F.col(c) - F.sum(f"{c}_removed").over(w)).alias(f"{c}_left") for c in ("mols", "meas")]
    return out.select("task", "step_no", "step", "mols_removed", "meas_removed", *left)


def clean_base(m: DataFrame, annotated: DataFrame) -> DataFrame:
    """Measurements of the entities that no step removes."""
    return m.where("mol_id IS NOT NULL").join(first_step(annotated).where("step IS NOT NULL").select("mol_id").distinct(), "mol_id", "left_anti")


def cutoff_year(cutoffs: DataFrame, models: list[str] | None = None, year: int | None = None) -> int | None:
    """The year given, else the latest of the selected models' own."""
    if year is not None:
        return year
    rows = cutoffs.where(F.col("model").isin(*models)) if models else cutoffs
    return rows.agg(F.max("cut_year")).first()[0]


def model_cutoffs(m: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(task, model, cutoff, basis, n_mols, n_meas): what each model's own year leaves of measurements, which :func:`clean_base` gives; a
    task that it leaves nothing has zeros."""
    years = m.where("mol_id IS NOT NULL").groupBy("task", "mol_id", "year").agg(F.count(F.lit(1)).alias("n"))
    # the few cutoffs stand in each row as one array: no join
    listed = cutoffs.agg(F.collect_list(F.struct("model", "cutoff", "basis", "cut_year")).alias("c")).first().c
    each = F.array(*[F.struct(F.lit(c.model).alias("model"), F.lit(c.cutoff).alias("cutoff"), F.lit(c.basis).alias("basis"), F.lit(c.cut_year).alias("cut_year")) for c in listed])
    rows = years.select("task", "mol_id", "year", "n", F.explode(each).alias("c")).select("task", "mol_id", "year", "n", "c.*")
    late = F.col("year") > F.col("cut_year")
    mols = rows.groupBy("task", "model", "cutoff", "basis", "mol_id").agg(F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("n"))
    return mols.groupBy("task", "model", "cutoff", "basis").agg(F.count_if(F.col("n") > 0).alias("n_mols"), F.sum("n").alias("n_meas"))


def model_table(m: DataFrame, annotated: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """model_cutoffs of the clean base with the entities before the year, and each task's share of entities that the model's registry
    sources hold; null where those are unknown."""
    base = clean_base(m, annotated)
    before = base.groupBy("task").agg(F.count_distinct("mol_id").alias("mols_after_steps12"))
    entities = m.where("mol_id IS NOT NULL").select("task", "mol_id").distinct().join(annotated.select("mol_id", "exact_sources"), "mol_id", "left")
    share_ = model_overlap(entities, cutoffs, "task")
    out = model_cutoffs(base, cutoffs).withColumnRenamed("n_mols", "mols_after_year")
    return out.join(before, "task", "left").join(share_, ["task", "model"], "left")


def model_summary(table: DataFrame) -> DataFrame:
    """By model over all tasks: entities left, and the overlap as a mean weighted by entities, where every task counts by its size."""
    weight = F.when(F.col("overlap").isNotNull(), F.col("n_entities"))
    return table.groupBy("model", "cutoff", "basis").agg(F.sum("mols_after_year").alias("mols_after_year"), (F.sum(weight * F.col("overlap")) / F.sum(weight)).alias("overlap"))


def model_overlap(annotated: DataFrame, cutoffs: DataFrame, *by: str) -> DataFrame:
    """Share of all entities that the registry sources of each model hold; null for a model of unknown sources."""
    seen = annotated.groupBy(*by, F.coalesce("exact_sources", F.array().cast("array<string>")).alias("exact_sources")).agg(F.count(F.lit(1)).alias("n"))
    listed = cutoffs.select("model", "sources").collect()  # a row for each model
    each = F.array(*[F.struct(F.lit(c.model).alias("model"), (F.array(*map(F.lit, c.sources)) if c.sources else F.lit(None)).cast("array<string>").alias("sources")) for c in listed])
    rows = seen.select(*by, "exact_sources", "n", F.explode(each).alias("m")).select(*by, "exact_sources", "n", "m.*")
    hit = F.sum(F.when(F.arrays_overlap("exact_sources", "sources"), F.col("n")).otherwise(0))
    return rows.groupBy(*by, "model").agg(F.when(F.first("sources").isNotNull(), hit / F.sum("n")).alias("overlap"), F.sum("n").alias("n_entities"))


def source_overlap(annotated: DataFrame) -> DataFrame:
    rows = annotated.select(F.explode("exact_sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source", "n", (F.col("n") / F.lit(float(annotated.count()))).alias("share"))


def similarity_quantiles(sims: DataFrame, at=(0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    return quantiles(sims, (), {f"q{int(100 * p):02d}": ("similarity", p) for p in at})


def similarity_histogram(sims: DataFrame, bins: int = 10) -> DataFrame:
    """Bins closed on the left, the last on both sides."""
    edges = [k / bins for k in range(1, bins)]
    at = sum((F.when(F.col("similarity") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return sims.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(sims: DataFrame, thresholds=(0.5, 0.6, 0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """Entities without an exact match above each threshold, and their share of all. sims: similarity, exact."""
    one = sims.agg(F.count(F.lit(1)).alias("n"), *[F.count_if((F.col("similarity") > t) & ~F.col("exact")).alias(f"t{k}") for k, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("removed")) for k, t in enumerate(thresholds)])
    return one.select("n", F.explode(rows).alias("r")).select("r.threshold", "r.removed", (F.col("r.removed") / F.col("n")).alias("share"))


def registry_totals(registry: DataFrame) -> DataFrame:
    """By source, and over all sources, where source is null."""
    return registry.select(F.explode(F.array("source", F.lit(None).cast("string"))).alias("source"), "key_full", "key_short").groupBy("source", "key_full", "key_short").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(
        F.sum("n").alias("n"), F.count_distinct("key_full").alias("n_full"), F.count_distinct("key_short").alias("n_short")
    )


def upsert(previous: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and previous ones whose key was not rebuilt."""
    return previous.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def exact_rate(annotated: DataFrame) -> DataFrame:
    return annotated.agg(share(F.col("exact_full")).alias("full_rate"), share(F.col("exact_short")).alias("short_rate"), F.count(F.lit(1)).alias("n"))
