"""Benchmarks over synthetic cases: fit, score held-out rows, measure, summarise."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import best_of_groups, split_rows, summarise
from ..sources.generators import Case, build
from .linear import Spec, add_reconstructions, add_scores, fit
from .metrics import basis_orthogonality, basis_recovery, held_out, latent_recovery, outcome_r2, reconstruction_mse, spread
from .neural import NeuralSpec, fit_neural, score_neural

MODELS = ("linear", "lend", "ned", "shared_private", "flow_v", "flow")


def accepted(function: Callable, options: Mapping[str, object]) -> dict[str, object]:
    """Only the options that a function takes."""
    return {k: v for k, v in options.items() if k in inspect.signature(function).parameters}


def _spec(model: str, k: int, sparsity: float, options: Mapping[str, object]) -> Spec | NeuralSpec:
    if model == "linear":
        return Spec(**{**accepted(Spec, options), "k": k, "quantile": sparsity})
    kind = {"shared_private": "ned_private"}.get(model, model)
    return NeuralSpec(**{**accepted(NeuralSpec, options), "kind": kind, "k": k, "quantile": sparsity})


def run_one(case: Case, model: str, k: int, sparsity: float = 0.0, train_share: float = 0.7, **options) -> dict[str, object]:
    """One fit on the first rows (by key), measured on the rest."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    parts = split_rows(case.df, "row_id", [train_share, 1 - train_share], ["train", "test"])
    train, test = (parts.where(parts["part"] == p).drop("part") for p in ("train", "test"))
    began = time.time()
    f = (fit if model == "linear" else fit_neural)(train, case.views, _spec(model, k, sparsity, options))
    took = time.time() - began
    put = (lambda d: add_reconstructions(add_scores(d, f), f)) if model == "linear" else (lambda d: score_neural(d, f))
    a, b = put(train), put(test)
    # a score by view where the topology gives one each: the first stands for all
    us = [c for c in b.columns if c.startswith("u_")][:k]
    out = {"model": model, "sparsity": sparsity, "fit_seconds": took, **spread(b, us), "recovery": latent_recovery(b, us, case.truth), "outcome_r2": outcome_r2(b, us, "y")}
    out |= {f"test_{m}": v for m, v in held_out(a, b, us, "y").items()}
    scaled = _scaled_test(b, f)
    out["recon_error"] = reconstruction_mse(scaled, case.views)
    if f.bases:
        out["orthogonality_defect"], out["v_recovery"] = basis_orthogonality(f.bases), basis_recovery(f.bases, case.bases)
    return out


def _scaled_test(df: DataFrame, f) -> DataFrame:
    for s in f.scalings.values():
        df = s.apply(df)
    return df


@dataclass
class Protocol:
    """A repeated benchmark with seeds, and its results."""

    cases: Callable[[int], Case]
    models: Sequence[str]
    k: int
    seeds: Sequence[int] = (42, 43, 44)
    sparsities: Sequence[float] = (0.0,)
    options: Mapping[str, object] = field(default_factory=dict)
    threads: int = 1

    def jobs(self) -> Iterable[tuple[int, str, float]]:
        return [(s, m, q) for s in self.seeds for m in self.models for q in self.sparsities]

    def run(self, spark: SparkSession) -> DataFrame:
        """All fits (``threads`` at a time), a row each."""

        def one(job: tuple[int, str, float]) -> dict[str, object]:
            seed, model, q = job
            return {"seed": seed, **run_one(self.cases(seed), model, self.k, q, **self.options)}

        with ThreadPoolExecutor(self.threads) as pool:
            rows = list(pool.map(one, self.jobs()))
        return spark.createDataFrame(pd.DataFrame(rows))


def sweep(spark: SparkSession, models: Sequence[str] = ("linear", "lend", "ned"), kind: str = "nonlinear_shared", k: int = 3, seeds: int = 3, sparsities: Sequence[float] = (0.0,), save: str | None = None, case: Mapping[str, object] | None = None, **options) -> dict[str, DataFrame]:
    """A sweep with its summary and the best setting of every model; saved as CSV if asked."""
    protocol = Protocol(lambda seed: build(spark, kind, **{**(case or {}), "k": k, "seed": seed}), models, k, range(42, 42 + seeds), sparsities, options)
    results = protocol.run(spark)
    measures = [c for c in results.columns if c not in ("model", "sparsity", "seed")]
    out = {"results": results, "summary": summarise(results, ["model", "sparsity"], measures), "best": best_of_groups(results, "model", "sparsity", "recovery")}
    if save:
        for name, df in out.items():
            df.write.mode("overwrite").csv(f"{save}_{name}", header=True)
    return out


def tune_shared_private(spark: SparkSession, k: int = 2, weights: Sequence[float] = (0.01, 0.05, 0.1, 0.5), variances: Sequence[float] = (0.05, 0.1, 0.2, 0.5), case: Mapping[str, object] | None = None, **options) -> DataFrame:
    """The grid of both private penalties, best recovery first."""
    data, rows = build(spark, "shared_plus_private", **{**(case or {}), "k": k}), []
    for w in weights:
        for v in variances:
            rows.append({"private_orthogonality": w, "private_variance": v, **run_one(data, "shared_private", k, private_orthogonality=w, private_variance=v, **options)})
    df = spark.createDataFrame(pd.DataFrame(rows))
    return df.orderBy(df["recovery"].desc())


def with_options(spec: Spec | NeuralSpec, **options) -> Spec | NeuralSpec:
    return replace(spec, **accepted(type(spec), options))
