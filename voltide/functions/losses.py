"""Forecast losses and metric sets.

Arguments are SQL text (a column name or an expression); a row with either side NULL does not
count.  Everything is one expression per metric, which keeps plans quick to build.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltide.functions.aggregates import corr0
from voltide.functions.columns import clip_text, floor_text


def qlike_text(true: str, pred: str, eps: float = 1e-10) -> str:
    r = f"({floor_text(true, eps)}) / ({floor_text(pred, eps)})"
    return f"({r} - ln({r}) - 1D)"


def squared_pct_text(true: str, pred: str, eps: float = 1e-10) -> str:
    t, p = floor_text(true, eps), floor_text(pred, eps)
    return f"pow((({t}) - ({p})) / ({t}), 2D)"


LOSSES = {"RMSPE": squared_pct_text, "QLIKE": qlike_text}


def qlike_loss(true: str, pred: str, eps: float = 1e-10) -> Column:
    return F.expr(qlike_text(true, pred, eps))


def squared_pct_loss(true: str, pred: str, eps: float = 1e-10) -> Column:
    return F.expr(squared_pct_text(true, pred, eps))


def qlike(true: str, pred: str, eps: float = 1e-10) -> Column:
    return F.expr(f"avg({qlike_text(true, pred, eps)})")


def rmspe(true: str, pred: str, eps: float = 1e-10) -> Column:
    return F.expr(f"sqrt(avg({squared_pct_text(true, pred, eps)}))")


def mse(true: str, pred: str, eps: float = 1e-12) -> Column:
    return F.expr(f"avg(pow(({floor_text(true, eps)}) - ({floor_text(pred, eps)}), 2D))")


def bias_pct(true: str, pred: str, eps: float = 1e-8) -> Column:
    t, p = floor_text(true, eps), floor_text(pred, eps)
    return F.expr(f"avg((({p}) - ({t})) / ({t})) * 100D")


def volatility_metrics(true: str, pred: str, eps: float = 1e-12) -> list[Column]:
    """RMSPE, QLIKE and MSE on realised volatility."""
    return [rmspe(true, pred, eps).alias("rmspe"), qlike(true, pred, eps).alias("qlike"), mse(true, pred, eps).alias("mse")]


def log_metrics(pred_log: str, true_log: str, eps: float = 1e-12, prefix: str = "") -> list[Column]:
    """Seven metrics from log predictions clipped to [-20, 5]."""
    p_log = f"({clip_text(pred_log, -20.0, 5.0)})"
    p, t = f"({floor_text(f'exp({p_log})', eps)})", f"({floor_text(f'exp({true_log})', eps)})"
    resid, r = f"({p} - {t})", f"({t} / {p})"
    out = {
        "qlike": f"avg({r} - ln({floor_text(r, eps)}) - 1D)",
        "rmspe_pct": f"sqrt(avg(pow({resid} / {t}, 2D))) * 100D",
        "mape_pct": f"avg(abs({resid}) / {t}) * 100D",
        "rmse": f"sqrt(avg({resid} * {resid}))",
        "mse_rv": f"avg({resid} * {resid})",
        "mae_log": f"avg(abs({p_log} - {true_log}))",
        "mse_log_rv": f"avg(pow({p_log} - {true_log}, 2D))",
    }
    return [F.expr(text).alias(prefix + name) for name, text in out.items()]


def dashboard_metrics(true: str, pred: str, eps: float = 1e-8) -> dict[str, Column]:
    """Scores of the dashboard."""
    return {
        "qlike": qlike(true, pred, eps),
        "rmspe": rmspe(true, pred, eps) * 100.0,
        "bias": bias_pct(true, pred, eps),
        "corr": corr0(pred, true),
    }
