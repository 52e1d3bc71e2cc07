"""Hyper-parameter search: all trials grow in the same jobs, weak ones are dropped at rungs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from statistics import pstdev

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.hashing import hash_unit
from flowlake.operators.boost import BoostData, BoostParams, Trainer, fit
from flowlake.operators.convergence import Patience
from flowlake.operators.model import BoostModel

# The search space, as (law, low, high) or (law, choices).
SEARCH_SPACE = {
    "eta": ("loguniform", 0.001, 0.8),
    "max_depth": ("randint", 2, 20),
    "min_child_weight": ("randint", 1, 25),
    "subsample": ("uniform", 0.3, 1.0),
    "colsample_bytree": ("uniform", 0.3, 1.0),
    "colsample_bylevel": ("uniform", 0.3, 1.0),
    "colsample_bynode": ("uniform", 0.3, 1.0),
    "reg_alpha": ("loguniform", 1e-10, 1000.0),
    "reg_lambda": ("loguniform", 1e-10, 1000.0),
    "gamma": ("loguniform", 1e-10, 10.0),
    "scale_pos_weight": ("loguniform", 0.1, 10.0),
    "max_delta_step": ("choice", (0, 1, 2, 5, 10)),
    "num_boost_round": ("randint", 10, 1000),
    "grow_policy": ("choice", ("depthwise", "lossguide")),
    "max_leaves": ("randint", 8, 4096),
}
# binary-only weight: drawn so that trials compare, without effect on multiclass trees
_UNUSED = ("scale_pos_weight",)


def _draw(law: tuple, u: Column) -> Column:
    kind, *rest = law
    if kind == "choice":
        options = rest[0]
        return F.array(*[F.lit(o) for o in options])[F.floor(u * len(options)).cast("int")]
    low, high = rest
    if kind == "randint":
        return (F.lit(low) + F.floor(u * (high - low))).cast("int")
    if kind == "uniform":
        return F.lit(low) + u * (high - low)
    if kind == "loguniform":
        return F.exp(F.lit(math.log(low)) + u * (math.log(high) - math.log(low)))
    raise ValueError(f"unknown law {kind}")


def sample_trials(spark: SparkSession, trials: int, seed: int = 42, space: dict = SEARCH_SPACE) -> DataFrame:
    """Trial table: one row per trial, one hashed draw per parameter."""
    table = spark.range(trials).withColumnRenamed("id", "trial")
    draws = {n: _draw(law, hash_unit(F.lit(seed), F.lit(n), "trial")) for n, law in space.items()}
    return table.select(F.col("trial").cast("int"), *[e.alias(n) for n, e in draws.items()])


def trial_params(trials: DataFrame, base: BoostParams = BoostParams()) -> dict[int, BoostParams]:
    """Parameter sets of the trial table (a few numbers per trial, held on the driver)."""
    found = {}
    for row in trials.collect():
        values = {k: v for k, v in row.asDict().items() if k != "trial" and k not in _UNUSED}
        values["rounds"] = values.pop("num_boost_round", base.rounds)
        if values.get("grow_policy", "depthwise") == "depthwise":
            values["max_leaves"] = 0
        found[row["trial"]] = replace(base, **values)
    return found


# What a failed trial scores.
FAILED = {"objective": 0.0, "mlogloss": math.inf, "accuracy": 0.0, "f1": 0.0}


def trial_patience(params: BoostParams) -> int:
    """Rounds a trial goes on without a new best validation loss: a tenth of its rounds, 10 at least."""
    return max(10, params.rounds // 10)


def successive_halving(
    data: BoostData,
    trials: dict[int, BoostParams],
    grace: int = 50,
    factor: int = 2,
    max_rounds: int | None = None,
    plateau: float | None = None,
    patience: int | None = None,
) -> DataFrame:
    """Grow all trials together; at rounds grace, grace*factor, ... keep the best 1/factor.

    Every running trial reports each round. It also ends when its own rounds are done, when its validation loss has not
    improved for ``patience`` rounds (its ``trial_patience`` unless given) or, with ``plateau``, once its last
    four reported objectives deviate by less than that. A trial whose parameters are unusable or whose
    numbers overflow scores 0; the others go on. What a trial reports depends on no other one.
    Margins of trials that are out leave the rows. Returns one row per trial.
    """
    results = {t: {"trial": t, "rounds": 0, **FAILED} for t in trials}
    alive = {t for t, p in trials.items() if p.fault() is None}
    trainer = Trainer(data, {t: trials[t] for t in sorted(alive)})
    reports: dict[int, list[float]] = {t: [] for t in trials}
    stops = {t: Patience(patience or trial_patience(trials[t])) for t in alive}
    rung, last = grace, max_rounds or max((p.rounds for p in trials.values()), default=0)
    for done in range(1, last + 1):
        if not alive:
            break
        trainer.drop(set(trials) - alive)
        trainer.round()
        for t in trainer.failed & alive:
            results[t].update(FAILED, rounds=done)
        alive -= trainer.failed
        if not alive:
            break
        running = sorted(alive)
        for row in trainer.scores(running).collect():
            t = row["track"]
            results[t].update({k: float(row[k]) for k in FAILED}, rounds=done)
            reports[t].append(row["objective"])
            spent = stops[t].spent(t, row["mlogloss"], done)
            flat = plateau is not None and len(reports[t]) >= 4 and pstdev(reports[t][-4:]) < plateau
            if spent or flat or trials[t].rounds == done:
                alive.discard(t)
        if done == rung:
            rung *= factor
            ranked = sorted(running, key=lambda t: (-results[t]["objective"], t))
            alive &= set(ranked[: max(1, len(running) // factor)])
    spark = data.rows.sparkSession
    names = ("trial", "rounds", "objective", "mlogloss", "accuracy", "f1")
    return spark.createDataFrame(
        [tuple(r[n] for n in names) for r in results.values()],
        "trial int, rounds int, objective double, mlogloss double, accuracy double, f1 double",
    )


def best_trial(results: DataFrame, metric: str = "objective", columns: Sequence[str] = ("trial",)) -> DataFrame:
    """The trial with the highest metric (smallest id among ties)."""
    order = F.struct(F.col(metric), -F.col("trial"))
    return results.agg(F.max(metric).alias(metric), *[F.max_by(c, order).alias(c) for c in columns])


def refit_best(data: BoostData, trials: dict[int, BoostParams], results: DataFrame) -> BoostModel:
    """Train the winning parameters alone, to their full number of rounds, on fresh margins."""
    winner = best_trial(results).first()["trial"]
    return fit(data, trials[winner])[0]
