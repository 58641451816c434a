"""Registered queries of the predictability and shrinkage studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators import memory, shrinkage
from pulsegrid.plans import inputs as I
from pulsegrid.plans.catalog import query, session_bipower, session_state
from pulsegrid.plans.catalog_sessions import DRAWS, SEED
from pulsegrid.plans.stages import stage

OUTCOMES = ["asinh_BV_PR", "asinh_PR_rv"]


@stage
def session_residuals(t: I.Tables) -> DataFrame:
    rows = session_bipower(t)
    return memory.cross_fit(rows, memory.battery(memory.specifications(rows), OUTCOMES))


@query()
def crossfit_residuals(t: I.Tables) -> DataFrame:
    return session_residuals(t)


@query()
def history_tests(t: I.Tables) -> DataFrame:
    return memory.history_tests(session_residuals(t), draws=DRAWS, seed=SEED)


@stage
def session_forecasts(t: I.Tables) -> DataFrame:
    rows = session_bipower(t)
    specs = {k: v for k, v in memory.specifications(rows).items() if k != "M0_mean"}
    parts = [memory.expanding_forecasts(rows, y, specs) for y in OUTCOMES]
    return parts[0].unionByName(parts[1])


@query()
def expanding_forecast(t: I.Tables) -> DataFrame:
    return session_forecasts(t)


@query()
def forecast_summary(t: I.Tables) -> DataFrame:
    return memory.forecast_summary(session_forecasts(t), DRAWS, seed=SEED)


def raw_power(t: I.Tables) -> DataFrame:
    return memory.periodogram(session_state(t)[1].select("root_code", "event_date", "asinh_PR_rv"), ["root_code"], "asinh_PR_rv")


@query()
def periodogram(t: I.Tables) -> DataFrame:
    return raw_power(t)


@query()
def local_whittle(t: I.Tables) -> DataFrame:
    keys = ["outcome", "model_name", "root_code", "series_type"]
    raw = session_state(t)[1].select(
        F.lit("asinh_PR_rv").alias("outcome"), F.lit("RAW").alias("model_name"), "root_code", F.lit("raw_outcome").alias("series_type"),
        "event_date", F.col("asinh_PR_rv").alias("value"),
    )
    fitted = session_residuals(t).select(
        "outcome", "model_name", "root_code", F.lit("crossfit_residual").alias("series_type"), "event_date", F.col("residual_cf").alias("value")
    )
    return memory.local_whittle(memory.periodogram(raw.unionByName(fitted), keys, "value"), keys)


@stage
def session_shrinkage(t: I.Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    # The interaction with the downside state is built for the models only; this panel never carries it.
    return shrinkage.shrinkage(session_state(t)[1].drop("target_x_preRSVneg"))


@query()
def shrinkage_path(t: I.Tables) -> DataFrame:
    return session_shrinkage(t)[0]


@query()
def shrinkage_selection(t: I.Tables) -> DataFrame:
    return session_shrinkage(t)[1]


@query()
def shrinkage_refit(t: I.Tables) -> DataFrame:
    return session_shrinkage(t)[2]
