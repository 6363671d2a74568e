"""Penalised additive models of any number of rows.

Each round of reweighting is one pass that adds up products of a few columns; rows never meet in one task. Smooth terms are cubic B-splines on even knots
with a penalty on second differences, held to a mean of zero. How much each is penalised follows from restricted likelihood (Fellner-Schall steps). One
grouping may have a random intercept for each level: levels stay a table, whose part is eliminated from the equations, so there may be millions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize, release
from .stats import complete

DEGREE = 3


def basis(x: np.ndarray, low: float, high: float, k: int) -> np.ndarray:
    """k cubic B-splines on even knots over [low, high]; values beyond count as the nearer end."""
    step = (high - low) / (k - DEGREE) or 1.0
    at = (np.clip(x, low, high) - low) / step
    cell = np.minimum(at.astype(int), k - DEGREE - 1)
    t = at - cell
    out = np.zeros((len(x), k))
    rows = np.arange(len(x))
    for j, piece in enumerate(((1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3)):
        out[rows, cell + j] = piece / 6
    return out


def digamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second derivative of log gamma, for positive arguments."""
    x, first, second = np.array(x, float), 0.0, 0.0
    for _ in range(8):
        first, second, x = first - 1 / x, second + 1 / x**2, x + 1
    q = 1 / x**2
    return first + np.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q / 252)), second + 1 / x + 0.5 * q + q / x * (1 / 6 - q * (1 / 30 - q / 42))


# --- responses --------------------------------------------------------------------------------------------------------


@dataclass
class Family:
    """gaussian (identity), poisson or tweedie (log; variance mu^power), or beta (logit; its precision is fitted with the rest)."""

    name: str = "gaussian"
    power: float = 1.5
    precision: float = 10.0
    edge: float = 1e-4  # beta responses are held this far from 0 and 1

    def response(self, y: np.ndarray) -> np.ndarray:
        return np.clip(y, self.edge, 1 - self.edge) if self.name == "beta" else y

    def link(self, mean: float) -> float:
        if self.name == "gaussian":
            return mean
        return float(np.log(mean / (1 - mean)) if self.name == "beta" else np.log(mean))

    def mean(self, eta: np.ndarray) -> np.ndarray:
        if self.name == "gaussian":
            return eta
        return 1 / (1 + np.exp(-np.clip(eta, -30, 30))) if self.name == "beta" else np.exp(np.clip(eta, -50, 50))

    def working(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and working responses of Fisher scoring."""
        mu = self.mean(eta)
        if self.name == "gaussian":
            return np.ones_like(y), y
        if self.name != "beta":
            return mu ** (2 - (1.0 if self.name == "poisson" else self.power)), eta + (y - mu) / mu
        (a, a2), (b, b2) = digamma(mu * self.precision), digamma((1 - mu) * self.precision)
        slope, info = mu * (1 - mu), self.precision**2 * (a2 + b2)
        return info * slope**2, eta + self.precision * (np.log(y / (1 - y)) - a + b) / (info * slope)

    def deviance(self, y: np.ndarray, mu: np.ndarray) -> np.ndarray:
        """Each row's part of the deviance; squared differences for beta, whose saturated likelihood has no bound."""
        if self.name in ("gaussian", "beta"):
            return (y - mu) ** 2
        if self.name == "poisson":
            return 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))
        p = self.power
        return 2 * (np.maximum(y, 0) ** (2 - p) / ((1 - p) * (2 - p)) - y * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p))

    def precision_score(self, y: np.ndarray, mu: np.ndarray) -> tuple[float, float]:
        """Slope of a beta likelihood along its precision, and the information about it."""
        f = self.precision
        (a, a2), (b, b2), (c, c2) = digamma(mu * f), digamma((1 - mu) * f), digamma(np.full_like(mu, f))
        return float((mu * (np.log(y / (1 - y)) - a + b) + np.log1p(-y) - b + c).sum()), float((mu**2 * a2 + (1 - mu) ** 2 * b2 - c2).sum())


def tweedie_log_density(y: np.ndarray, mu: np.ndarray, scale: float, power: float) -> np.ndarray:
    """Log density for a power between 1 and 2: exp(-lambda) at zero, else a Poisson sum of gammas around its largest part."""
    p, out = power, -(mu ** (2 - power)) / (scale * (2 - power))
    yes = y > 0
    v, m = y[yes], mu[yes]
    if not len(v):
        return out
    shape = (2 - p) / (p - 1)
    top = np.maximum(1, np.round(v ** (2 - p) / (scale * (2 - p))))
    wide = int(np.ceil(8 * np.sqrt(top.max()) + 20))
    gammas = np.frompyfunc(math.lgamma, 1, 1)
    log_w = np.empty(len(v))
    for i in range(0, len(v), 2048):
        at = slice(i, i + 2048)
        n = top[at, None] + np.arange(-wide, wide + 1)
        ok, n = n >= 1, np.maximum(n, 1)
        term = n * (shape * np.log(v[at, None]) - shape * np.log(p - 1) - (1 + shape) * np.log(scale) - np.log(2 - p)) - gammas(n + 1).astype(float) - gammas(n * shape).astype(float)
        term[~ok] = -np.inf
        peak = term.max(axis=1)
        log_w[at] = peak + np.log(np.exp(term - peak[:, None]).sum(axis=1))
    out[yes] = log_w - np.log(v) + (v * m ** (1 - p) / (1 - p) - m ** (2 - p) / (2 - p)) / scale
    return out


# --- terms ------------------------------------------------------------------------------------------------------------


@dataclass
class Design:
    """What turns rows into columns: an intercept, linear terms and smooth terms with their range and map to a mean of zero."""

    linear: list[str]
    smooth: dict[str, tuple[float, float, int, np.ndarray]] = field(default_factory=dict)

    def columns(self, rows: pd.DataFrame) -> np.ndarray:
        parts = [np.ones((len(rows), 1)), *(rows[t].to_numpy(float)[:, None] for t in self.linear)]
        parts += [basis(rows[t].to_numpy(float), low, high, k) @ z for t, (low, high, k, z) in self.smooth.items()]
        return np.hstack(parts)

    def places(self) -> dict[str, slice]:
        out, at = {}, 1
        for t in self.linear:
            out[t], at = slice(at, at + 1), at + 1
        for t, (_, _, _, z) in self.smooth.items():
            out[t], at = slice(at, at + z.shape[1]), at + z.shape[1]
        return out

    def penalties(self, select: bool) -> list[tuple[str, np.ndarray, int]]:
        """Term, penalty matrix and rank; with `select` also one on the straight line, so that a term can vanish."""
        size, out = 1 + len(self.linear) + sum(z.shape[1] for *_, z in self.smooth.values()), []
        for t, at in self.places().items():
            if t not in self.smooth:
                continue
            _, _, k, z = self.smooth[t]
            d = np.diff(np.eye(k), 2, axis=0) @ z
            values, vectors = np.linalg.eigh(d.T @ d)
            flat = vectors[:, values < values.max() * 1e-10]
            for block, rank in [(d.T @ d, k - 2), *([(flat @ flat.T, flat.shape[1])] if select and flat.shape[1] else [])]:
                s = np.zeros((size, size))
                s[at, at] = block
                out.append((t, s, rank))
        return out


def totals(df: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all rows of the vector that f makes of a batch of rows."""

    def parts(batches):
        total = None
        for rows in batches:
            if len(rows):
                v = f(rows)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    out = np.zeros(size)
    for r in df.mapInPandas(parts, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row for each product
        out[r.i] = r.v
    return out


@dataclass
class Fit:
    """A fitted model; `levels` is the table of random intercepts (group, effect), if any."""

    family: Family
    design: Design
    beta: np.ndarray
    terms: DataFrame
    stats: dict
    group: str | None = None
    levels: DataFrame | None = None

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """Adds the expected response; levels never seen have no effect, rows that lack a term get null."""
        design, beta, family, used = self.design, self.beta, self.family, [*self.design.linear, *self.design.smooth]
        if self.levels is not None:
            df = df.join(self.levels.select(F.col(self.group).alias("_level"), F.col("effect").alias("_effect")), F.col(self.group) == F.col("_level"), "left").drop("_level")
        else:
            df = df.withColumn("_effect", F.lit(0.0))

        @F.pandas_udf("double")
        def mean(rows: pd.DataFrame) -> pd.Series:
            ok = np.isfinite(rows.to_numpy(float)).all(axis=1)
            out = np.full(len(rows), np.nan)
            out[ok] = family.mean(design.columns(rows[ok]) @ beta + rows["_effect"].to_numpy(float)[ok])
            return pd.Series(out)

        made = mean(F.struct(*(F.col(t).cast("double").alias(t) for t in used), F.coalesce("_effect", F.lit(0.0)).alias("_effect")))
        return df.withColumn(name, F.nanvl(made, F.lit(None).cast("double"))).drop("_effect")

    def partial(self, spark, term: str, n: int = 50) -> DataFrame:
        """A smooth term's part of the linear predictor at n even places of its range: term, x, effect."""
        low, high, k, z = self.design.smooth[term]
        x = np.linspace(low, high, n)
        return spark.createDataFrame([(term, float(a), float(b)) for a, b in zip(x, basis(x, low, high, k) @ z @ self.beta[self.design.places()[term]])], "term string, x double, effect double")


# --- fitting ----------------------------------------------------------------------------------------------------------


def prepare(df: DataFrame, y: str, smooth: dict[str, int], linear: list[str], group: str | None, series: list[str], month: str | None) -> DataFrame:
    """Complete rows with the columns in use, and beside each the row of the month before in its series (null where it is missing)."""
    used = [*linear, *smooth]
    rows = complete(df, [y, *used]).select(F.col(y).cast("double").alias("_y"), *(F.col(t).cast("double").alias(t) for t in used), *([F.col(group).alias("_g")] if group else []),
                                           *([*(F.col(s).alias(f"_s{i}") for i, s in enumerate(series)), F.col(month).cast("int").alias("_m")] if month else []))
    if group:
        rows = rows.filter(F.col("_g").isNotNull())
    if not month:
        return rows
    keys = [f"_s{i}" for i in range(len(series))]
    before = rows.select(*keys, (F.col("_m") + 1).alias("_m"), *(F.col(c).alias("_b" + c) for c in ("_y", *used)))
    return rows.join(before, [*keys, "_m"], "left").drop(*keys, "_m")


def fit(df: DataFrame, y: str, smooth: dict[str, int], linear: list[str] = (), family: Family | None = None, group: str | None = None, series: list[str] = (),
        month: str | None = None, rho: float = 0.0, select: bool = False, rounds: int = 40, tolerance: float = 1e-4) -> Fit | None:
    """Fits y on smooth terms (term: number of splines, 5 at least), linear terms and a random intercept for each level of `group`.

    With `month` (a month index, once in each series) errors follow an AR(1) with coefficient rho within a series; a row whose month before is missing starts
    anew; a series lies within one level. Rows with a null, NaN or infinite value are left out; a smooth term with one value only is left out; None without rows or, under a log link, with
    no positive response. Terms: term, kind, columns, edf, penalty, concurvity (the largest share of a function of this term that the other terms can
    give) and observed (that share of the fitted function).
    """
    family, linear = family or Family(), list(linear)
    spark, names = df.sparkSession, [*smooth]
    rows = prepare(df, y, smooth, linear, group, list(series), month)
    if group:  # rows of a level lie together, so a batch holds few levels; ranges go on within a level, so a large one fills no task
        rows = rows.repartitionByRange("_g", *names, *linear).sortWithinPartitions("_g")
    rows = materialize(rows, "gam")
    first = rows.agg(F.count("*").alias("n"), F.avg("_y").alias("y"), *(f(t).alias(f"{c}{i}") for i, t in enumerate(names) for c, f in (("l", F.min), ("h", F.max)))).first()
    n = first.n
    if not n or (family.name not in ("gaussian", "beta") and first.y <= 0):
        release(spark, rows)
        return None
    ranges = {t: (first[f"l{i}"], first[f"h{i}"], max(smooth[t], DEGREE + 2)) for i, t in enumerate(names) if first[f"l{i}"] < first[f"h{i}"]}
    sums = totals(rows, lambda b: np.concatenate([np.zeros(1), *(basis(b[t].to_numpy(float), *r).sum(axis=0) for t, r in ranges.items())]), 1 + sum(r[2] for r in ranges.values()))[1:]
    design, at = Design(linear), 0
    for t, r in ranges.items():
        q = np.linalg.qr(sums[at:at + r[2], None], mode="complete")[0]
        design.smooth[t], at = (*r, q[:, 1:]), at + r[2]
    p, penalties = 1 + len(linear) + sum(z.shape[1] for *_, z in design.smooth.values()), design.penalties(select)
    beta = np.zeros(p)
    beta[0] = family.link(min(max(first.y, family.edge), 1 - family.edge) if family.name == "beta" else first.y)
    lam, lam_g, levels, older, lagged = np.ones(len(penalties)), 1.0, None, [], bool(month) and rho != 0
    root = np.sqrt(1 - rho**2)

    def with_effect() -> DataFrame:
        if group is None:
            return rows
        return rows.withColumn("_effect", F.lit(0.0)) if levels is None else rows.join(levels, "_g", "left").fillna(0.0, ["_effect"])

    def scaled(b: pd.DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of (columns, working response) times root weights, whitened, and the same of a column of ones for the group."""

        def made(rows: pd.DataFrame) -> np.ndarray:
            x = design.columns(rows)
            w, z = family.working(family.response(rows["_y"].to_numpy(float)), x @ beta + (rows["_effect"].to_numpy(float) if group else 0.0))
            return np.sqrt(w)[:, None] * np.column_stack([x, z, np.ones(len(rows))])

        v = made(b)
        if lagged:
            has = b["_b_y"].notna().to_numpy()
            v[has] = (v[has] - rho * made(b[has].assign(**{c: b["_b" + c] for c in ("_y", *linear, *names)}))) / root
        return v[:, :-1], v[:, -1]

    size, edf_g = p + 1, 0.0
    for turn in range(rounds):
        def products(b: pd.DataFrame, beta=beta, v=None) -> np.ndarray:
            v = scaled(b, beta)[0] if v is None else v
            extra = np.zeros(2)
            if family.name == "beta":
                x = design.columns(b) @ beta + (b["_effect"].to_numpy(float) if group else 0.0)
                extra = np.array(family.precision_score(family.response(b["_y"].to_numpy(float)), family.mean(x)))
            return np.concatenate([(v.T @ v).ravel(), extra])

        by_level, c, q, small = None, 0.0, np.zeros((size, size)), np.zeros(2)
        if group:
            def by_group(batches, beta=beta):
                """One pass: the products of a level in each batch, and of all rows of the task under no level."""
                total = None
                for b in batches:
                    if len(b):
                        v, ones = scaled(b, beta)
                        got = pd.DataFrame(np.column_stack([ones**2, ones[:, None] * v])).groupby(b["_g"].to_numpy()).sum()
                        yield pd.DataFrame({"_g": got.index, "v": list(got.to_numpy())})
                        more = products(b, beta, v)
                        total = more if total is None else total + more
                if total is not None:
                    yield pd.DataFrame({"_g": pd.Series([None], dtype=object), "v": [total]})

            kind, v = rows.schema["_g"].dataType.simpleString(), F.col("v")
            parts = materialize(with_effect().mapInPandas(by_group, f"_g {kind}, v array<double>"), "gam-parts")
            got = np.zeros(size * size + 2)
            for r in parts.filter("_g is null").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row for each product
                got[r.i] = r.v
            made = parts.filter("_g is not null").groupBy("_g").agg(F.array(*(F.sum(v[i]) for i in range(size + 1))).alias("v"))
            by_level = materialize(made, "gam-levels")
            delete(spark, parts._table_path)

            def eliminated(b: pd.DataFrame) -> np.ndarray:
                v = np.stack(b["v"].to_numpy())
                d, u = v[:, 0] + lam_g, v[:, 1:]
                return np.concatenate([(u.T @ (u / d[:, None])).ravel(), (u.T @ (u / d[:, None] ** 2)).ravel(), [(1 / d).sum(), len(b)]])

            less = totals(by_level, eliminated, 2 * size * size + 2)
            c, q, small = less[:size * size].reshape(size, size), less[size * size:-2].reshape(size, size), less[-2:]
        else:
            got = totals(rows, products, size * size + 2)
        g, score = got[:-2].reshape(size, size), got[-2:]
        h = g - c
        for _ in range(100):  # penalties of the smooth terms settle on these products, without another pass over the rows
            s = sum((a * m for a, (_, m, _) in zip(lam, penalties)), np.zeros((p, p)))
            inverse = np.linalg.pinv(h[:p, :p] + s, hermitian=True)
            new = inverse @ h[:p, p]
            around = np.append(-new, 1.0)
            effects2 = float(around @ q @ around)
            loss = float(around @ h @ around) - lam_g * effects2 if group else float(around @ g @ around)  # of the rows alone
            trace_g = float(small[0] + np.trace(inverse @ q[:p, :p])) if group else 0.0
            edf_g = float(small[1] - lam_g * trace_g) if group else 0.0
            edf = p - sum(a * float(np.trace(inverse @ m)) for a, (_, m, _) in zip(lam, penalties)) + edf_g
            scale = max(loss, 1e-300) / max(1.0, n - edf) if family.name != "beta" else 1.0
            step_l = []
            for a, (_, m, rank) in zip(lam, penalties):
                bend = float(new @ m @ new)
                step_l.append(min(1e9, max(1e-9, a * scale * max(1e-12, rank / a - float(np.trace(inverse @ m))) / max(bend, 1e-300))))
            if not len(lam) or np.abs(np.log(np.array(step_l) / lam)).max() < 1e-3:
                break
            lam = np.array(step_l)
        step = new - beta  # how far fitted values move against the noise; what is left after a step is of the order of its square
        moved = math.sqrt(max(0.0, float(step @ g[:p, :p] @ step)) / (n * scale + 1e-9 * g[p, p] + 1e-300))
        if group:
            old = levels
            solve = [float(b) for b in new]
            v = F.col("v")
            effect = (v[p + 1] - sum((F.lit(b) * v[i + 1] for i, b in enumerate(solve)), F.lit(0.0))) / (v[0] + lam_g)
            levels = materialize(by_level.select("_g", effect.alias("_effect")), "gam-effects")
            for done in [by_level, *([old] if old is not None else [])]:
                delete(spark, done._table_path)
        if group:
            next_g = min(1e9, max(1e-9, lam_g * scale * max(1e-12, small[1] / lam_g - trace_g) / max(effects2, 1e-300)))
            moved = max(moved, abs(np.log(next_g / lam_g)) * 0.01 * edf_g / small[1])  # levels that have all but vanished move nothing
        if family.name == "beta":
            jump = float(np.clip(score[0] / max(score[1], 1e-300) / family.precision, -1, 1))
            family = Family("beta", family.power, family.precision * float(np.exp(jump)), family.edge)
            moved = max(moved, abs(jump))
        beta, used_l, used_g = new, lam, lam_g
        if moved < tolerance or turn == rounds - 1:
            break
        if group:
            lam_g = next_g
    def last(b: pd.DataFrame) -> np.ndarray:
        x = design.columns(b)
        mu, v = family.mean(x @ beta + (b["_effect"].to_numpy(float) if group else 0.0)), family.response(b["_y"].to_numpy(float))
        return np.concatenate([(x.T @ x).ravel(), [family.deviance(v, mu).sum(), family.deviance(v, np.full_like(mu, mean_y)).sum()]])

    mean_y = min(max(first.y, family.edge), 1 - family.edge) if family.name == "beta" else first.y
    got = totals(with_effect(), last, p * p + 2)
    plain, out, places = got[:-2].reshape(p, p), [], design.places()
    share = np.diag(inverse @ h[:p, :p])
    for t, at in places.items():
        mine = list(range(p))[at]
        others = [i for i in range(p) if i not in mine]
        own, between = plain[np.ix_(mine, mine)], plain[np.ix_(mine, others)]
        given = between @ np.linalg.pinv(plain[np.ix_(others, others)], hermitian=True) @ between.T
        worst = float(np.max(np.real(np.linalg.eigvals(np.linalg.pinv(own, hermitian=True) @ given))))
        f = beta[mine]
        penalty = next((float(a) for a, (name, _, _) in zip(used_l, penalties) if name == t), None)
        out.append((t, "smooth" if t in design.smooth else "linear", len(mine), float(share[mine].sum()), penalty, min(1.0, max(0.0, worst)), float(f @ given @ f / max(float(f @ own @ f), 1e-300))))
    if group:
        out.append((group, "group", int(small[1]), edf_g, float(used_g), None, None))
    stats = {"n": n, "edf": float(edf), "scale": float(scale), "rounds": turn + 1, "deviance_explained": float(1 - got[-2] / got[-1]) if got[-1] > 0 else None, "rho": rho,
             "precision": family.precision if family.name == "beta" else None, "power": family.power if family.name == "tweedie" else None, "gcv": float(n * loss / max(1.0, n - edf) ** 2)}
    if family.name == "tweedie":
        power = family.power

        def likely(b: pd.DataFrame) -> np.ndarray:
            mu = family.mean(design.columns(b) @ beta + (b["_effect"].to_numpy(float) if group else 0.0))
            return np.array([tweedie_log_density(b["_y"].to_numpy(float), mu, scale, power).sum()])

        stats["log_likelihood"] = float(totals(with_effect(), likely, 1)[0])
    release(spark, rows)
    table = spark.createDataFrame(out, "term string, kind string, columns int, edf double, penalty double, concurvity double, observed double")
    return Fit(family, design, beta, table, stats, group, levels.select(F.col("_g").alias(group), F.col("_effect").alias("effect")) if group else None)


def best_power(df: DataFrame, y: str, smooth: dict[str, int], powers: list[float], **options) -> Fit | None:
    """The Tweedie fit whose power makes the response likeliest."""
    fits = [f for p in powers if (f := fit(df, y, smooth, family=Family("tweedie", p), **options))]
    return max(fits, key=lambda f: f.stats["log_likelihood"]) if fits else None
