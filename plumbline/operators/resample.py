"""Cluster bootstraps over entities, from an entity's sums instead of its rows.

``hash``: draw i of resample b takes the entity whose ordinal is a hash of (seed, b, i) modulo their number: exactly as many
draws as entities, the same in any engine; draws are counted where they are made, and a block of entities meets its counts. ``poisson``: each entity's weight in resample b is a Poisson(1) number, from the b-th state of
a multiplicative congruential generator (48271, modulo 2 ** 31 - 1) that its own hash begins. It needs no ordinals and no join:
tasks multiply weights and values as matrices and pass on sums, so that resamples are one partial aggregate of any number of
rows, none of which moves: the form for scale, and that of the queries.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clip, ratio
from ..functions.stored import kept
from .order import ranks
from .replicate import doc_level, entity_stats
from .splits import hash_unit, ranked

DRAWS = 500
PRIME, FACTOR = (1 << 31) - 1, 48271
#: States from which on a weight is at least 1, 2, ...
STEPS = [math.ceil(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Entities whose weights a task holds at once, those made in one step, and groups whose sums.
CHUNK, STEP, GROUPS = 2048, 64, 2000
#: Entities that meet their counts at once, and draws whose hashes a task holds.
BLOCK, HASHED = 1 << 15, 1 << 18


def factors(draws: int) -> list[int]:
    return [pow(FACTOR, b + 1, PRIME) for b in range(draws)]


def pick(seed: int, b: str, i: str, n: str) -> Column:
    """The ordinal that draw i of resample b takes."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(b).cast("string"), F.col(i).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.col(n))


def numbered_entities(entities: DataFrame, *by: str, key: str = "mol_id") -> DataFrame:
    """(by, key, at, g): each entity's ordinal from 0, in order of its own hash, and how many there are."""
    keys = entities.select(*by, key).distinct().withColumn("__h", hash_unit(0, *by, key))
    keys = ranked(keys.withColumn("__b", F.shiftright("__h", 20)), list(by), "__b", "__h", key)
    return kept(keys.select(*by, key, (F.col("__at") - 1).alias("at"), F.col("__n").alias("g")), "numbered")


def hash_weights(entities: DataFrame, draws: int, seed: int, *by: str, key: str = "mol_id") -> DataFrame:
    """(by, key, drawn): the resamples that draw each entity, one entry for each time; entities that none draws have no row. In each
    resample as many draws as ``by`` has entities. Ordinals follow the entities' own hash: counts of lower hashes and a place
    among those of the same leading bits, so that no task's entities meet in one sort."""
    keys = numbered_entities(entities, *by, key=key)
    numbered = keys.select(*by, key, "at")
    sizes = keys.groupBy(*by).agg(F.first("g").alias("g"))
    # few rows that become many: dealt out before they do
    spark = entities.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    picks = sizes.select(*by, "g", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).repartition(tasks, *by, "b").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("i"))
    drawn = picks.select(*by, "b", pick(seed, "b", "i", "g").alias("at")).groupBy(*by, "at").agg(F.collect_list("b").alias("drawn"))
    return drawn.join(numbered, [*by, "at"]).select(*by, key, "drawn")


MARK = "\u0001"


def _labelled(by: list[str]) -> Column:
    """One string for the group of a row; a mark tells a null from an empty one."""
    return F.concat_ws(MARK, *[F.coalesce(F.col(c), F.lit("\u0002")) for c in by]).alias("__g")


def poisson_weights(state: np.ndarray, draws: int) -> np.ndarray:
    """The weights, a row for each state and a column for each resample. State times factor is reduced modulo 2 ** 31 - 1 by adding its
    upper bits to its lower ones; a few states at once, so that what a step reads is still at hand."""
    factor, out = np.array(factors(draws), np.int64), np.zeros((len(state), draws), np.uint8)
    for at in range(0, len(state), STEP):
        s = state[at : at + STEP, None] * factor
        s = (s & PRIME) + (s >> 31)
        s = np.where(s >= PRIME, s - PRIME, s).astype(np.int32)
        most = s.max(initial=0)
        for step in STEPS:
            if most < step:
                break
            out[at : at + STEP] += s >= step
    return out


def poisson_sums(rows: DataFrame, by: list[str], values: list[str], draws: int = DRAWS, seed: int = 0, keys: tuple = ("task", "mol_id")) -> DataFrame:
    """(by, b, values): sums of the values (doubles without nulls) over the rows of each resample, weighted by their entity. An entity,
    which the keys name, has the same weight in all its rows. by: columns of strings. Rows needn't be added up by entity before:
    they stay where they are, and the weights of those that lie together are made once."""
    state = (hash_unit(seed, *keys) % (PRIME - 1) + 1).alias("__state")
    sent = rows.select(_labelled(by), state, *[F.col(v).cast("double").alias(v) for v in values])

    def task(batches):
        held: dict[str, np.ndarray] = {}

        def told():
            names, sums = list(held), np.concatenate(list(held.values())) if held else np.zeros((0, len(values)))
            columns = [pa.array(np.repeat(np.array(names, object), draws), pa.string()), pa.array(np.tile(np.arange(draws, dtype=np.int32), len(names)))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns + [pa.array(sums[:, j]) for j in range(len(values))], names=["__g", "b", *values])

        for batch in batches:
            coded = batch.column("__g").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values], 1)
            states, entity = np.unique(batch.column("__state").to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(entity, kind="stable")
            cuts = np.searchsorted(entity[order], range(0, len(states) + CHUNK, CHUNK))
            for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
                first = i * CHUNK
                w, part = poisson_weights(states[first : first + CHUNK], draws), order[low:high]
                part = part[np.argsort(code[part], kind="stable")]
                own = code[part]
                ends = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(part)]
                for a, b in zip(ends, ends[1:]):
                    if a < b:
                        name, mine = names[own[a]], part[a:b]
                        held[name] = held.get(name, 0) + w[entity[mine] - first].T.astype(np.float64) @ x[mine]
            if len(held) > GROUPS:
                yield told()
        yield told()

    sums = sent.mapInArrow(task, ", ".join(["__g string", "b int", *[f"{v} double" for v in values]]))
    out = sums.groupBy("__g", "b").agg(*[F.sum(v).alias(v) for v in values])
    parts = F.split("__g", MARK)
    return out.select(*[F.nullif(F.get(parts, F.lit(i)), F.lit("\u0002")).alias(c) for i, c in enumerate(by)], "b", *values)


def draw_counts(spark, sizes: list[int], draws: int, seed: int) -> DataFrame:
    """(g, block, b, counts): how often resample b draws each entity of a block of ordinals, for groups of those sizes: two bytes an entity,
    low byte first. A draw's hash is the same in every group, so it is made once and taken modulo each group's number."""

    def task(batches):
        ns = np.array(sizes, np.int64)
        for batch in batches:
            for b in batch.column("id").to_pylist():
                counts, begin = [np.zeros(n, np.uint16) for n in sizes], f"{seed}|{b}|".encode()
                for low in range(0, int(ns.max()), HASHED):
                    own = [md5(begin + b"%d" % i).digest()[:4] for i in range(low, min(low + HASHED, int(ns.max())))]
                    h = np.frombuffer(b"".join(own), ">u4").astype(np.int64)
                    for c, n in zip(counts, sizes):
                        if n > low:
                            np.add.at(c, h[: n - low] % n, 1)
                for g, c in enumerate(counts):
                    parts = [c[at : at + BLOCK].astype("<u2").tobytes() for at in range(0, len(c), BLOCK)]
                    columns = [pa.array([g] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int64()), pa.array([b] * len(parts), pa.int32()), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["g", "block", "b", "counts"])

    # a task for each few resamples: what one holds is two bytes an entity
    return spark.range(0, draws, 1, min(draws, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(task, "g int, block long, b int, counts binary")


def exact_sums(rows: DataFrame, by: list[str], values: list[str], draws: int = DRAWS, seed: int = 0, of: tuple[str, ...] = ("task",), key: str = "mol_id") -> DataFrame:
    """The same where each resample draws exactly as many entities as there are in ``of``, a part of by. The draws are those of
    :func:`hash_weights`, but no draw is a row: a block of entities meets its counts, and is multiplied by them."""
    spark, empty = rows.sparkSession, rows.select(_labelled(by), F.lit(0).alias("b"), *[F.col(v).cast("double").alias(v) for v in values])
    numbered = numbered_entities(rows, *of, key=key)
    sizes = numbered.groupBy(*of).agg(F.first("g").alias("n")).collect()
    parts = F.split("__g", MARK)
    back = [*[F.nullif(F.get(parts, F.lit(i)), F.lit("\u0002")).alias(c) for i, c in enumerate(by)], "b", *values]
    if not sizes:
        return empty.select(*back)
    schema = ", ".join([*[f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in of], "__group int"])
    groups = spark.createDataFrame([(*[r[c] for c in of], i) for i, r in enumerate(sizes)], schema)
    placed = rows.join(numbered.join(F.broadcast(groups), list(of)).select(*of, key, "at", "__group"), [*of, key])
    sent = placed.select(F.col("__group").alias("g"), F.floor(F.col("at") / BLOCK).alias("block"), (F.col("at") % BLOCK).cast("int").alias("at"), _labelled(by), *[F.col(v).cast("double").alias(v) for v in values])
    counts = draw_counts(spark, [r.n for r in sizes], draws, seed)

    def block(entities, drawn):
        if entities.empty or drawn.empty:
            return pd.DataFrame({"__g": pd.Series([], dtype=object), "b": pd.Series([], dtype="int32"), **{v: pd.Series([], dtype=float) for v in values}})
        w, b = np.stack([np.frombuffer(x, "<u2") for x in drawn["counts"]]), drawn["b"].to_numpy()
        out = []
        for name, own in entities.groupby("__g", sort=False):
            at, x = own["at"].to_numpy(), own[values].to_numpy(float)
            sums = sum(w[:, at[i : i + CHUNK]].astype(float) @ x[i : i + CHUNK] for i in range(0, len(at), CHUNK))
            out.append(pd.DataFrame({"__g": name, "b": b.astype("int32"), **{v: sums[:, j] for j, v in enumerate(values)}}))
        return pd.concat(out)

    schema = ", ".join(["__g string", "b int", *[f"{v} double" for v in values]])
    sums = sent.groupBy("g", "block").cogroup(counts.groupBy("g", "block")).applyInPandas(block, schema)
    return sums.groupBy("__g", "b").agg(*[F.sum(v).alias(v) for v in values]).select(*back)


def interval(x: str, name: str, alpha: float = 0.05) -> list[Column]:
    return [F.percentile(x, F.lit(p)).alias(f"{name}_{s}") for p, s in ((alpha / 2, "lo"), (0.5, "med"), (1 - alpha / 2, "hi"))]


def ceiling_draws(m: DataFrame, draws: int = DRAWS, seed: int = 0, min_docs: int = 2, max_range: float = 3.0, mode: str = "poisson") -> DataFrame:
    """(task, b, sigma, rmse_floor, r2_max)."""
    stats = entity_stats(doc_level(m))
    keep = (F.col("n") >= min_docs) & (F.col("range") <= max_range)
    one = lambda x: F.when(keep, x).otherwise(0.0).cast("double")
    values = {"ss": one(F.col("ss")), "dof": one(F.col("n") - 1), "sw": F.lit(1.0), "s1": F.col("mean"), "s2": F.col("mean") * F.col("mean"), "inv": 1 / F.col("n")}
    rows = stats.select("task", "mol_id", *[v.alias(k) for k, v in values.items()])
    sums = (poisson_sums if mode == "poisson" else exact_sums)(rows, ["task"], list(values), draws, seed)
    noise, k = ratio("ss", "dof"), ratio("inv", "sw")
    var = ratio(F.col("s2") - F.col("s1") * F.col("s1") / F.nullif(F.col("sw"), F.lit(0.0)), F.col("sw") - 1)
    return sums.select("task", "b", F.sqrt(noise).alias("sigma"), F.sqrt(noise * k).alias("rmse_floor"), clip(1 - ratio(noise * k, var), 0.0, 1.0).alias("r2_max"))


def ceiling_intervals(m: DataFrame, draws: int = DRAWS, seed: int = 0, mode: str = "poisson") -> DataFrame:
    d = ceiling_draws(m, draws, seed, mode=mode)
    return d.groupBy("task").agg(*interval("sigma", "sigma"), *interval("rmse_floor", "rmse_floor"), *interval("r2_max", "r2_max"), F.count("sigma").alias("n_valid_draws"))


def _terms(p: DataFrame) -> dict[str, Column]:
    """Of a row of predictions: one, squared errors of the model and of the train mean, label noise; a null adds nothing."""
    error, base = F.col("y") - F.col("pred"), F.col("y") - F.col("y_train_mean")
    return {"n": F.lit(1.0), **{n: F.coalesce(x, F.lit(0.0)) for n, x in (("e2", error * error), ("b2", base * base), ("inv", 1 / F.col("n_docs")))}}


def _enough(p: DataFrame) -> DataFrame:
    """The (task, split, model) with ten rows or more."""
    return p.groupBy("task", "split", "model").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("task", "split", "model")


def pooled_sums(p: DataFrame) -> DataFrame:
    """Sums of each model's rows by (task, split, model, entity): rows, squared errors of the model and of the train mean, label noise.
    Tasks and splits of fewer than ten rows are left out."""
    mols = p.groupBy("task", "split", "model", "mol_id").agg(*[F.sum(x).alias(n) for n, x in _terms(p).items()])
    return mols.join(_enough(p), ["task", "split", "model"], "left_semi")


def _fractions(sums: DataFrame, ceilings: DataFrame, *keys: str) -> DataFrame:
    out = sums.where("n > 0").join(ceilings.select("task", "sigma"), "task")
    rmse, mean, floor = F.sqrt(F.col("e2") / F.col("n")), F.sqrt(F.col("b2") / F.col("n")), F.col("sigma") * F.sqrt(F.col("inv") / F.col("n"))
    return out.select(*keys, rmse.alias("rmse"), ratio(mean - rmse, mean - floor).alias("frac"))


def fraction_draws(p: DataFrame, ceilings: DataFrame, draws: int = DRAWS, seed: int = 0, sigma_draws: DataFrame | None = None, mode: str = "poisson") -> DataFrame:
    """(task, split, model, b, rmse, frac): every model of a task and split on the same resamples of its entities. With sigma_draws
    (task, b, sigma), each resample has the noise of its own. Mode ``hash`` draws exactly as many entities as a task's split has."""
    by, values = ["task", "split", "model"], ["n", "e2", "b2", "inv"]
    if mode == "poisson":
        sums = poisson_sums(p.select(*by, "mol_id", *[x.alias(n) for n, x in _terms(p).items()]), by, values, draws, seed).join(_enough(p), by, "left_semi")
    else:
        sums = exact_sums(kept(pooled_sums(p), "pooled"), by, values, draws, seed, ("task", "split"))
    if sigma_draws is not None:
        return _fractions_with(sums, sigma_draws)
    return _fractions(sums, ceilings, "task", "split", "model", "b")


def _fractions_with(sums: DataFrame, sigma_draws: DataFrame) -> DataFrame:
    joined = sums.where("n > 0").join(sigma_draws.select("task", "b", "sigma"), ["task", "b"])
    rmse, mean, floor = F.sqrt(F.col("e2") / F.col("n")), F.sqrt(F.col("b2") / F.col("n")), F.col("sigma") * F.sqrt(F.col("inv") / F.col("n"))
    return joined.select("task", "split", "model", "b", rmse.alias("rmse"), ratio(mean - rmse, mean - floor).alias("frac"))


def pooled_fractions(p: DataFrame, ceilings: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """(task, split, model, n_mols, frac_pooled, frac_lo, frac_hi): the fraction over all rows, and its interval over entities, by
    ``drawn``, the :func:`fraction_draws`."""
    sums = p.groupBy("task", "split", "model").agg(*[F.sum(x).alias(n) for n, x in _terms(p).items()], F.count_distinct("mol_id").alias("n_mols")).where("n >= 10")
    point = _fractions(sums, ceilings, "task", "split", "model", "n_mols").withColumnRenamed("frac", "frac_pooled").drop("rmse")
    ends = fraction_intervals(fraction_draws(p, ceilings) if drawn is None else drawn).select("task", "split", "model", "frac_lo", "frac_hi")
    return point.join(ends, ["task", "split", "model"], "left")


def task_intervals(tasks: DataFrame, value: str = "frac_ceiling", draws: int = DRAWS, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(split, model, lo, hi) of the mean over tasks, resampling tasks; null for fewer than two tasks."""
    known = tasks.where(F.col(value).isNotNull())
    sums = poisson_sums(known.select("task", "split", "model", F.lit(1.0).alias("n"), F.col(value).alias("v")), ["split", "model"], ["n", "v"], draws, seed, ("task",))
    ends = sums.where("n > 0").withColumn("mean", F.col("v") / F.col("n")).groupBy("split", "model").agg(*[F.percentile("mean", F.lit(q)).alias(x) for q, x in ((alpha / 2, "lo"), (1 - alpha / 2, "hi"))])
    several = known.groupBy("split", "model").agg(F.count_distinct("task").alias("k"))
    return ends.join(several, ["split", "model"]).select("split", "model", *[F.when(F.col("k") >= 2, F.col(x)).alias(x) for x in ("lo", "hi")])


def metric_intervals(p: DataFrame, draws: int = DRAWS, seed: int = 0, stored: bool = False) -> DataFrame:
    """Intervals of rmse, mae, r2 and Spearman's rho of each (task, split, model) over entities; rho by the ranks in all rows."""
    keys = ["task", "split", "model"]
    sizes = kept(p.groupBy(*keys).agg((F.count(F.lit(1)) / 2.0).alias("middle")), "sizes")
    r = ranks(p.select(*keys, "mol_id", "y", "pred"), keys, {"ry": "y", "rp": "pred"}, stored).join(sizes, keys)
    error = F.col("y") - F.col("pred")
    terms = {"n": F.lit(1.0), "e2": error * error, "e1": F.abs(error), "y1": F.col("y"), "y2": F.col("y") * F.col("y")}
    # ranks from their middle, so that sums of products stay exact
    ra, rb = (F.col(c) - F.col("middle") for c in ("ry", "rp"))
    terms |= {"a1": ra, "b1": rb, "aa": ra * ra, "bb": rb * rb, "ab": ra * rb}
    d = poisson_sums(r.select(*keys, "mol_id", *[t.alias(k) for k, t in terms.items()]), keys, list(terms), draws, seed).where("n > 0")
    var = F.col("y2") / F.col("n") - (F.col("y1") / F.col("n")) * (F.col("y1") / F.col("n"))
    va, vb = (F.col(x + x) - F.col(f"{x}1") * F.col(f"{x}1") / F.col("n") for x in "ab")
    d = d.select(
        *keys, F.sqrt(F.col("e2") / F.col("n")).alias("rmse"), (F.col("e1") / F.col("n")).alias("mae"), F.when(var > 1e-12, 1 - F.col("e2") / F.col("n") / var).alias("r2"),
        F.when((va > 1e-9) & (vb > 1e-9), (F.col("ab") - F.col("a1") * F.col("b1") / F.col("n")) / F.sqrt(va * vb)).alias("spearman"),
    )
    return d.groupBy(*keys).agg(*[x for m in ("rmse", "mae", "r2", "spearman") for x in interval(m, m)])


def fraction_intervals(d: DataFrame) -> DataFrame:
    return d.groupBy("task", "split", "model").agg(*interval("frac", "frac"), *interval("rmse", "rmse"), F.count("frac").alias("n_valid_draws"))


def aggregate_intervals(d: DataFrame) -> DataFrame:
    """Intervals of the mean over tasks, resample by resample."""
    return d.groupBy("split", "model", "b").agg(F.avg("frac").alias("frac")).groupBy("split", "model").agg(*interval("frac", "frac"))


def paired_intervals(d: DataFrame, baseline: str) -> DataFrame:
    """Difference from the baseline: interval, and twice the smaller tail at zero."""
    base = d.where(F.col("model") == baseline).select("task", "split", "b", F.col("frac").alias("base"))
    rows = d.where(F.col("model") != baseline).join(base, ["task", "split", "b"]).withColumn("d", F.col("frac") - F.col("base")).where("d IS NOT NULL")
    out = rows.groupBy("task", "split", "model").agg(*interval("d", "diff"), F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("low"), F.avg(F.when(F.col("d") >= 0, 1.0).otherwise(0.0)).alias("high"))
    out = out.withColumn("p_boot", F.least(F.lit(1.0), 2 * F.least("low", "high"))).drop("low", "high")
    return out.withColumn("inside_noise", (F.col("diff_lo") <= 0) & (F.col("diff_hi") >= 0))
