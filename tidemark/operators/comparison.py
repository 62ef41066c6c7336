"""Run several models over one dataset and score them against the last-value benchmark."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from tidemark.operators.boosted import boosted_over
from tidemark.operators.metrics import metrics_table
from tidemark.operators.walkforward import Walk, naive_over, open_walk, ridge_over
from tidemark.schemas import NAIVE, feature_columns
from tidemark.session import stage

# A model is a scorer over a walk: numbered rows, whose folds and checks all models share.
MODELS: dict[str, Callable[..., DataFrame]] = {
    NAIVE: lambda walk, names, **options: naive_over(walk, **options),
    "ridge": ridge_over,
    "boosted_trees": boosted_over,
}
# Other names that may be asked for; forecasts carry the name of the model that ran.
ALIASES = {"lightgbm": "boosted_trees"}


def walk_forward(
    dataset: DataFrame,
    model_name: str,
    min_train_size: int = 24,
    features: Sequence[str] | None = None,
    by: Sequence[str] = ("target_id",),
    **options,
) -> DataFrame:
    """Walk-forward forecasts of one model by name."""
    model_name = ALIASES.get(model_name, model_name)
    if model_name not in MODELS:
        raise ValueError(f"No model is called {model_name}; there are {sorted(MODELS)}.")
    names = [] if model_name == NAIVE else feature_columns(dataset, features)
    return _run(open_walk(dataset, min_train_size, by, names), model_name, names, **options)


def _run(walk: Walk, model_name: str, names: Sequence[str], **options) -> DataFrame:
    return MODELS[model_name](walk, names, model_name=model_name, **options)


def union_forecasts(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def requested_models(models: Sequence[str]) -> list[str]:
    """The models in order without repeats; none or an unknown one is an error."""
    named = list(dict.fromkeys(ALIASES.get(m, m) for m in models))
    if not named or not set(named) <= set(MODELS):
        raise ValueError(f"Asked to compare {list(models)}; choose one or more of {sorted(MODELS)}.")
    return named


def compare_models(
    dataset: DataFrame,
    models: Sequence[str],
    min_train_size: int = 24,
    features: Sequence[str] | None = None,
    options: dict[str, dict] | None = None,
    by: Sequence[str] = ("target_id",),
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of the requested models and their metrics table.

    The benchmark always runs, but is returned only if requested. Rows are checked, numbered
    and staged once, and every model scores that one fold table. Note that ridge fits each
    timeline on its own, boosted trees all targets together.
    """
    wanted = requested_models(models)
    to_run = wanted if NAIVE in wanted else [*wanted, NAIVE]
    names = feature_columns(dataset, features) if set(to_run) != {NAIVE} else []
    walk = open_walk(dataset, min_train_size, by, names).staged()
    chosen = {ALIASES.get(m, m): o for m, o in (options or {}).items()}
    everything = stage(union_forecasts([_run(walk, m, names, **chosen.get(m, {})) for m in to_run]))
    naive = everything.where(everything.model_name == NAIVE)
    metrics = metrics_table(everything, naive, wanted)
    return everything.where(everything.model_name.isin(wanted)), metrics
