"""GARCH(1,1) forecast per (stock, snapshot).

Each snapshot's returns (at most 480) travel as one array; ``FIT_ROWS`` arrays of an Arrow batch are fitted at
once by vectorised scoring steps, so Python cost is per batch, not per row, and its memory is bounded.
Estimates approximate maximum likelihood (zero mean, normal errors, returns in percent).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.constants import INPUT_END, PRICE_EPS, RETURN_CLIP, RV_FLOOR, TARGET_END
from voltide.functions.aggregates import in_window
from voltide.functions.losses import log_metrics
from voltide.operators.book import SNAPSHOT, returns_by_piece
from voltide.operators.har_models import baseline_rv

MIN_RET_STD = 1e-8
SCALE = 100.0
HORIZON = TARGET_END - INPUT_END
MIN_INPUT_ROWS, MIN_TARGET_ROWS = 5, 1
FIT_ROWS = 512


def _shares(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unconstrained (log omega, persistence logit, arch-share logit) to (omega, alpha, beta)."""
    persist = 1.0 / (1.0 + np.exp(-theta[1]))
    share = 1.0 / (1.0 + np.exp(-theta[2]))
    return np.exp(theta[0]), persist * share, persist * (1.0 - share)


def _filter(y2: np.ndarray, live: np.ndarray, s0: np.ndarray, theta: np.ndarray, slopes: bool):
    """Negative log likelihood, next variance and, if asked, score and information per row."""
    omega, alpha, beta = _shares(theta)
    persist, share = alpha + beta, np.divide(alpha, alpha + beta)
    n, m = y2.shape
    var, prev = s0.copy(), s0.copy()
    nll = np.zeros(n)
    d = np.zeros((3, n))
    score, info = np.zeros((3, n)), np.zeros((3, 3, n))
    for t in range(m + 1):
        lag2 = prev if t == 0 else y2[:, t - 1]
        if slopes:
            d_new = np.stack([omega, (persist * (1 - persist)) * (share * lag2 + (1 - share) * var),
                              persist * share * (1 - share) * (lag2 - var)]) + beta * d
        nxt = np.clip(omega + alpha * lag2 + beta * var, 1e-12, 1e12)
        on = live[:, t - 1] if t else np.ones(n, bool)
        var = np.where(on, nxt, var)
        if slopes:
            d = np.where(on, d_new, d)
        if t == m:
            break
        cur = live[:, t]
        nll += np.where(cur, 0.5 * (np.log(var) + y2[:, t] / var), 0.0)
        if slopes:
            g = np.where(cur, 0.5 * (1.0 - y2[:, t] / var) / var, 0.0)
            score += g * d
            h = np.where(cur, 0.5 / (var * var), 0.0)
            info += h * d[:, None, :] * d[None, :, :]
    return nll, var, score, info


def fit_batch(y: np.ndarray, lengths: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fit all rows of a padded batch; returns (sum of forecast variances, ok, converged, negative log likelihood).

    The best of a grid of starts is refined by ``steps`` scoring steps that are taken only where the likelihood rises;
    a row has converged when a step gains next to nothing or none can be found.
    """
    n, m = y.shape
    live = np.arange(m)[None, :] < lengths[:, None]
    y2 = np.where(live, y * y, 0.0)
    mean2 = np.maximum(y2.sum(1) / np.maximum(lengths, 1), 1e-12)
    # Start-up variance: exponentially weighted over the first 75 squared returns.
    w = np.where(live[:, :75], 0.94 ** np.arange(min(m, 75))[None, :], 0.0)
    s0 = np.maximum((w * y2[:, :75]).sum(1) / np.maximum(w.sum(1), 1e-300), 1e-12)

    best, best_nll = None, np.full(n, np.inf)
    for persist in (0.5, 0.9, 0.98):
        for share in (0.05, 0.2, 0.5):
            theta = np.stack([np.log(mean2 * (1 - persist)), np.full(n, np.log(persist / (1 - persist))),
                              np.full(n, np.log(share / (1 - share)))])
            nll = _filter(y2, live, s0, theta, False)[0]
            better = nll < best_nll
            best = theta if best is None else np.where(better, theta, best)
            best_nll = np.where(better, nll, best_nll)
    damp = np.full(n, 1e-3)
    settled = np.zeros(n, bool)
    for _ in range(steps):
        _, _, score, info = _filter(y2, live, s0, best, True)
        a = np.moveaxis(info, 2, 0).copy()
        diag = np.einsum("nii->ni", a)
        diag += damp[:, None] * np.maximum(diag, 1e-8) + 1e-10
        move = np.linalg.solve(a, -score.T[:, :, None])[:, :, 0].T
        trial = best + np.clip(move, -2.0, 2.0)
        trial[1:] = np.clip(trial[1:], -9.0, 9.0)
        nll = _filter(y2, live, s0, trial, False)[0]
        better = nll < best_nll
        gain = np.where(better, best_nll - nll, 0.0)
        best = np.where(better, trial, best)
        best_nll = np.where(better, nll, best_nll)
        damp = np.clip(np.where(better, damp / 4, damp * 8), 1e-6, 1e8)
        settled |= (better & (gain < 1e-9)) | (damp > 1e6)
        if settled.all():
            break
    _, nxt, _, _ = _filter(y2, live, s0, best, False)
    omega, alpha, beta = _shares(best)
    persist = alpha + beta
    longrun = omega / (1.0 - persist)
    total = HORIZON * longrun + (nxt - longrun) * (1.0 - persist ** HORIZON) / (1.0 - persist)
    return total, np.isfinite(total) & (total > 0) & np.isfinite(best_nll), settled, best_nll


def _forecasts(steps: int, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, FIT_ROWS):
                part = batch.slice(first, FIT_ROWS)
                inp = part.column("inp")
                arrays = np.split(inp.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(inp).to_numpy())[:-1])
                lengths = np.array([len(a) for a in arrays])
                padded = np.zeros((len(arrays), max(lengths)))
                for i, a in enumerate(arrays):
                    padded[i, : len(a)] = a
                usable = np.array([a.std() >= MIN_RET_STD for a in arrays], dtype=bool)
                pred, likelihood = np.full(len(arrays), np.nan), np.full(len(arrays), np.nan)
                converged = np.zeros(len(arrays), bool)
                if usable.any():
                    total, ok, settled, nll = fit_batch(padded[usable] * SCALE, lengths[usable], steps)
                    pred[usable] = np.where(ok, np.sqrt(np.where(ok, total, 0.0)) / SCALE, np.nan)
                    likelihood[usable], converged[usable] = nll, settled & ok
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(pred), pa.array(likelihood), pa.array(converged)],
                                                 [*others, "garch_rv", "neg_log_likelihood", "converged"])
    return run


def fitted_rows(inputs: DataFrame, steps: int = 25) -> DataFrame:
    """``inputs`` with garch_rv (null where no fit), neg_log_likelihood and converged in place of the returns."""
    others = [n for n in inputs.columns if n != "inp"]
    schema = ", ".join(f"{n} {t}" for n, t in inputs.dtypes if n != "inp") + ", garch_rv double, neg_log_likelihood double, converged boolean"
    fitted = inputs.mapInArrow(_forecasts(steps, others), schema)
    return fitted.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("garch_rv", "neg_log_likelihood")})


def grid_forecasts(book_sec: DataFrame) -> DataFrame:
    """Forecast by the best of the start grid alone, which every engine computes alike."""
    return fitted_rows(garch_inputs(book_sec), 0).select(*SNAPSHOT, "garch_rv", "neg_log_likelihood", "n_input_obs")


def garch_inputs(book_sec: DataFrame) -> DataFrame:
    """Per snapshot: ordered input returns of every second, input and target RV, counts of seconds."""
    rows = returns_by_piece(book_sec, PRICE_EPS, first=0.0, clip=RETURN_CLIP, every=120)
    early, late = in_window(None, INPUT_END), in_window(INPUT_END, TARGET_END)
    r = F.col("log_return")
    ordered = F.sort_array(F.collect_list(F.when(early, F.struct("seconds_in_bucket", "log_return", "seconds"))))
    return rows.groupBy(*SNAPSHOT).agg(
        F.flatten(F.transform(ordered, lambda s: F.concat(F.array(s["log_return"]), F.array_repeat(F.lit(0.0), s["seconds"] - 1)))).alias("inp"),
        F.sum(F.when(early, F.col("seconds")).otherwise(0)).cast("int").alias("n_input_obs"),
        F.sum(F.when(late, F.col("seconds")).otherwise(0)).cast("int").alias("n_future_obs"),
        F.sqrt(F.sum(F.when(early, r * r))).alias("rv_in_raw"),
        F.sqrt(F.sum(F.when(late, r * r))).alias("rv_fut_raw"),
    ).where((F.col("n_input_obs") >= MIN_INPUT_ROWS) & (F.col("n_future_obs") >= MIN_TARGET_ROWS))


def garch_predictions(book_sec: DataFrame, solver: bool = True) -> DataFrame:
    """Forecast table; snapshots that cannot be fitted fall back to scaled input RV.

    ``solver=False`` gives the fallback forecast for every row (the benchmark model).
    """
    inputs = garch_inputs(book_sec)
    if solver:
        fitted = fitted_rows(inputs)
    else:
        fitted = inputs.drop("inp").withColumn("garch_rv", F.lit(None).cast("double"))
    scaled = baseline_rv(F.col("rv_in_raw"), F.col("n_input_obs"), F.col("n_future_obs"))
    base = fitted.select(
        *SNAPSHOT,
        F.greatest("rv_fut_raw", F.lit(RV_FLOOR)).alias("true_rv"),
        F.greatest(F.coalesce(F.col("garch_rv"), scaled), F.lit(PRICE_EPS)).alias("pred_rv"),
        F.greatest("rv_in_raw", F.lit(MIN_RET_STD)).alias("_rv_in"),
        F.col("garch_rv").isNull().cast("int").alias("fallback"), *(["converged"] if solver else []), "n_input_obs", "n_future_obs",
    )
    logs = base.withColumns({
        "true_log_rv": F.log(F.col("true_rv") + PRICE_EPS), "pred_log_rv": F.log(F.col("pred_rv") + PRICE_EPS),
        "anchor_log_rv": F.log(F.col("_rv_in") + PRICE_EPS),
    })
    return logs.select(
        *SNAPSHOT, "true_rv", "pred_rv", "true_log_rv", "pred_log_rv", "anchor_log_rv",
        (F.col("true_log_rv") - F.col("anchor_log_rv")).alias("true_log_rv_diff"),
        (F.col("pred_log_rv") - F.col("anchor_log_rv")).alias("pred_log_rv_diff"),
        "fallback", *(["converged"] if solver else []), "n_input_obs", "n_future_obs",
    )


def fold_report(predictions: DataFrame) -> DataFrame:
    """Per fold: metrics of the forecast and of the last-RV benchmark, and the shares of fallbacks and, if told, of fits that did not converge."""
    told = [(F.avg((~F.col("converged") & (F.col("fallback") == 0)).cast("double")) * 100.0).alias("unconverged_pct")] if "converged" in predictions.columns else []
    return predictions.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows_eval"), (F.avg("fallback") * 100.0).alias("fallback_pct"), *told,
        *log_metrics("pred_log_rv", "true_log_rv", 1e-12, "garch_"),
        *log_metrics("anchor_log_rv", "true_log_rv", 1e-12, "last_"),
    )


def per_stock_report(predictions: DataFrame, keys: list[str] = ["stock_id"], min_rows: int = 5) -> DataFrame:
    """Seven metrics per stock for stocks with at least ``min_rows`` rows, best RMSPE first."""
    return (
        predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *log_metrics("pred_log_rv", "true_log_rv"))
        .where(F.col("n_rows") >= min_rows).orderBy("rmspe_pct", *keys)
    )
