"""A panel regression with autoregressive errors fitted on all rows at once, against which the one from sums of products is held."""

from __future__ import annotations

import numpy as np
import pandas as pd

from shoalwork.operators.stats import aicc, gaussian_llf


class PanelFit:
    """One fit. rows has region, mi, y and the drivers; drivers are used as they are."""

    def __init__(self, rows: pd.DataFrame, drivers: list[str], order: int, most_lags: int | None = None, harmonics: int = 2, trend: bool = True, rounds: int = 50):
        rows = rows.sort_values(["region", "mi"], kind="stable").drop_duplicates(["region", "mi"])
        self.drivers, self.order, self.harmonics, self.trend = drivers, order, harmonics, trend
        self.regions = sorted(rows["region"].unique().tolist())
        self.region, self.mi = rows["region"].map({r: i for i, r in enumerate(self.regions)}).to_numpy(), rows["mi"].to_numpy(np.int64)
        self.y, self.x = rows["y"].to_numpy(float), self.design(self.region, self.mi, rows[drivers].to_numpy(float))
        lags = max(order, most_lags or 0)
        self.back = {h: self.earlier(h) for h in range(1, lags + 1)}
        # one sample for all orders up to most_lags, so that their criteria compare
        self.sample = np.flatnonzero(np.all([b >= 0 for b in self.back.values()], axis=0)) if lags else np.arange(len(self.y))
        self.rho, self.beta = np.zeros(order), np.zeros(self.x.shape[1])
        self.usable = len(self.sample) > self.x.shape[1] + order
        if self.usable:
            self.fit(rounds)

    def design(self, region: np.ndarray, mi: np.ndarray, drivers: np.ndarray) -> np.ndarray:
        turn = 2 * np.pi * (mi % 12 + 1) / 12
        season = [f(k * turn) for k in range(1, self.harmonics + 1) for f in (np.sin, np.cos)]
        columns = [(region == i).astype(float) for i in range(len(self.regions))] + season + ([(mi - 24000) / 12.0] if self.trend else [])
        return np.column_stack([*columns, drivers]) if len(self.drivers) else np.column_stack(columns)

    def names(self) -> list[tuple[str, str]]:
        season = [(f"{f}{k}", "season") for k in range(1, self.harmonics + 1) for f in ("sin", "cos")]
        return [(f"region {r}", "region") for r in self.regions] + season + ([("trend", "trend")] if self.trend else []) + [(d, "driver") for d in self.drivers]

    def earlier(self, h: int) -> np.ndarray:
        """The row of the same region exactly h months before each row, -1 where there is none."""
        key = self.region.astype(np.int64) * 1_000_000 + self.mi
        at = np.searchsorted(key, key - h)
        return np.where((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key - h), at, -1)

    def differenced(self, v: np.ndarray) -> np.ndarray:
        """Rows of the sample less the errors' carry-over from earlier months."""
        return v[self.sample] - sum((r * v[self.back[h][self.sample]] for h, r in enumerate(self.rho, 1)), np.zeros(1))

    def fit(self, rounds: int) -> None:
        """Cochrane and Orcutt's rounds: coefficients on differenced rows, then the autoregression of what they leave."""
        for _ in range(max(1, rounds)):
            xd, yd = self.differenced(self.x), self.differenced(self.y)
            self.beta = np.linalg.lstsq(xd, yd, rcond=None)[0]
            if not self.order:
                break
            left = np.full(len(self.y), np.nan)
            left[self.sample] = (self.y - self.x @ self.beta)[self.sample]
            behind = np.column_stack([left[self.back[h][self.sample]] for h in range(1, self.order + 1)])
            ok = np.isfinite(behind).all(1)
            new = np.linalg.lstsq(behind[ok], left[self.sample][ok], rcond=None)[0] if ok.sum() > self.order + 1 else np.zeros(self.order)
            moved, self.rho = np.abs(new - self.rho).max(), new
            if moved < 1e-7:
                break
        xd, yd = self.differenced(self.x), self.differenced(self.y)
        self.beta = np.linalg.lstsq(xd, yd, rcond=None)[0]
        e = yd - xd @ self.beta
        n, k = xd.shape
        months, of = np.unique(self.mi[self.sample], return_inverse=True)
        scores = np.zeros((len(months), k))
        np.add.at(scores, of, xd * e[:, None])
        bread, g = np.linalg.pinv(xd.T @ xd), len(months)
        # errors by clusters of one month, with the usual correction for few clusters
        self.cov = bread @ (scores.T @ scores) @ bread * (g / max(1, g - 1)) * ((n - 1) / max(1, n - k))
        self.n, self.clusters = n, g
        self.criterion = aicc(gaussian_llf(max(float(e @ e), 1e-300), n), k + self.order + 1, n)

    def residuals(self) -> np.ndarray:
        """What is left of every row of the sample, in the units of y; NaN elsewhere."""
        out = np.full(len(self.y), np.nan)
        if self.usable:
            out[self.sample] = (self.y - self.x @ self.beta)[self.sample]
        return out

    def forecast(self, ahead: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Expected y of rows with region, mi and the drivers, and how many earlier errors each could use. NaN for a new region."""
        place = {r: i for i, r in enumerate(self.regions)}
        region = np.array([place.get(r, -1) for r in ahead["region"]])
        mi = ahead["mi"].to_numpy(np.int64)
        out = self.design(region, mi, ahead[self.drivers].to_numpy(float)) @ self.beta
        left = {(int(r), int(m)): e for r, m, e in zip(self.region, self.mi, self.residuals()) if np.isfinite(e)}
        used = np.zeros(len(ahead), int)
        for h, rho in enumerate(self.rho, 1):
            e = np.array([left.get((int(r), int(m) - h), np.nan) for r, m in zip(region, mi)])
            used += np.isfinite(e)
            out = out + rho * np.nan_to_num(e)
        return np.where(region >= 0, out, np.nan), used
