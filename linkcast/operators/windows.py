"""Ordered-window features: lags, rolling statistics, averages, autocorrelation, trend.

Each feature family states how far its frames reach and yields its columns in
levels; a level may use columns of earlier levels. ``add_features`` merges the
levels of all families, so any number of families runs on one exchange and one
sort of the signal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcast.functions.scalar import is_missing
from linkcast.operators.ordering import Frame, Signal, spread

Levels = list[dict[str, Column]]


def shifted(f: Frame, name: str, offsets, default=None) -> dict[str, Column]:
    """One column per offset of ``name``; families of one call share them."""
    return {_at(name, k): f.lag(name, k, default) for k in sorted(set(offsets)) if k}


def _at(name: str, k: int) -> str:
    return f"_{name}_at{k}" if k else name


@dataclass(frozen=True)
class Lags:
    """Lagged levels or first differences, e.g. ``OptPow_diff_lag5``."""

    lags: tuple[int, ...]
    use_diff: bool = True
    base: str = "OptPow"

    def reach(self):
        return max((*self.lags, 0)) + 1, 0

    def names(self):
        stem = f"{self.base}_diff" if self.use_diff else self.base
        return [f"{stem}_lag{k}" for k in self.lags]

    def levels(self, f: Frame) -> Levels:
        at = lambda k: F.col(_at(self.base, k))
        near = shifted(f, self.base, [k + i for k in self.lags for i in range(1 + self.use_diff)])
        cols = [at(k) - at(k + 1) if self.use_diff else at(k) for k in self.lags]
        return [near, dict(zip(self.names(), cols))]


@dataclass(frozen=True)
class Diff:
    """First difference of the signal."""

    base: str = "OptPow"

    def reach(self):
        return 1, 0

    def names(self):
        return [f"{self.base}_diff"]

    def levels(self, f: Frame) -> Levels:
        return [
            shifted(f, self.base, [1]),
            {self.names()[0]: F.col(self.base) - F.col(_at(self.base, 1))},
        ]


@dataclass(frozen=True)
class Targets:
    """Change over ``horizon`` samples and the level it starts from.

    ``ahead=False`` labels a row by the time that is predicted; ``ahead=True``
    by the time at which the forecast is made.
    """

    horizons: tuple[int, ...]
    ahead: bool = False
    base: str = "OptPow"

    def reach(self):
        h = max(self.horizons)
        return (0, h) if self.ahead else (h, 0)

    def names(self):
        if self.ahead:
            return [f"target_{h}" for h in self.horizons]
        return [n for h in self.horizons for n in (f"{self.base}_lag{h}", f"target_{h}")]

    def levels(self, f: Frame) -> Levels:
        x, cols = F.col(self.base), {}
        offsets = [-h if self.ahead else h for h in self.horizons]
        for h, k in zip(self.horizons, offsets):
            there = F.col(_at(self.base, k))
            if self.ahead:
                cols[f"target_{h}"] = there - x
            else:
                cols[f"{self.base}_lag{h}"] = there
                cols[f"target_{h}"] = x - there
        return [shifted(f, self.base, offsets), cols]


@dataclass(frozen=True)
class Rolling:
    """Trailing mean, sample deviation, minimum and maximum over ``windows`` rows.

    Shorter frames count once ``min_periods`` values are there
    (``None``: only full windows).
    """

    windows: tuple[int, ...] = (5, 10, 20, 50)
    stats: tuple[str, ...] = ("mean", "std", "min", "max")
    min_periods: int | None = 1
    base: str = "OptPow"

    def __post_init__(self):
        unknown = set(self.stats) - {"mean", "std", "min", "max"}
        if unknown:
            raise ValueError(f"unknown rolling statistics: {sorted(unknown)}")

    def reach(self):
        return max(self.windows) - 1, 0

    def names(self):
        return [f"{self.base}_rolling_{s}_{w}" for w in self.windows for s in self.stats]

    def levels(self, f: Frame) -> Levels:
        x = F.col(self.base)
        agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        cols = {}
        for w in self.windows:
            need = w if self.min_periods is None else self.min_periods
            for s in self.stats:
                c = f.over(agg[s](x), -(w - 1), 0)
                if need > 1:
                    c = F.when(f.over(F.count(x), -(w - 1), 0) >= need, c)
                cols[f"{self.base}_rolling_{s}_{w}"] = c
        return [cols]


def moving_average(window: int, base: str = "OptPow") -> Rolling:
    """Plain trailing mean."""
    return Rolling((window,), ("mean",), 1, base)


def ema_reach(alpha: float) -> int:
    """Rows after which a value's weight has fallen below double precision."""
    return 1 if alpha >= 1 else ceil(41.5 / -log(1 - alpha))


@dataclass(frozen=True)
class Ema:
    """Exponential moving averages.

    ``adjust=False``: e_0 = x_0, e_t = (1-a) e_{t-1} + a x_t.
    ``adjust=True``: sum (1-a)^i x_{t-i} / sum (1-a)^i.

    The recursion is a running sum of x weighted by (1-a)^-position inside a
    run of rows, scaled back by (1-a)^position, plus what the run before hands
    over. A run is so long that anything older weighs less than 1e-18.
    """

    alphas: tuple[float, ...] = (0.1, 0.3, 0.5)
    adjust: bool = False
    base: str = "OptPow"
    stem: str | None = None

    def __post_init__(self):
        if any(not 0 < a <= 1 for a in self.alphas):
            raise ValueError("alpha must lie in (0, 1]")

    @property
    def run_rows(self) -> int:
        return max((ema_reach(a) for a in self.alphas if not self._steep(a)), default=1)

    def _steep(self, alpha: float) -> bool:
        # Large factors fade within a few rows: a short weighted sum does it.
        return alpha >= 1 or 1 / -log(1 - alpha) < 1.0

    def reach(self):
        return 2 * max(self.run_rows, *(ema_reach(a) for a in self.alphas)), 0

    def _name(self, a: float) -> str:
        return f"{self.stem or self.base + '_ema'}_{str(a).replace('.', '_')}"

    def names(self):
        return [self._name(a) for a in self.alphas]

    def levels(self, f: Frame) -> Levels:
        # The frames per run come first: their sort also serves all others.
        first, handed, second = {}, {}, {}
        pos = F.col("seq") % self.run_rows
        for i, a in enumerate(self.alphas):
            r = 1 - a
            # The first value of a series stands for the whole past before it.
            x = F.col(self.base)
            if not self.adjust:
                x = F.when(F.col("seq") == 0, x / a).otherwise(x)
            if self._steep(a):
                terms = [x * a] if a >= 1 else [
                    F.coalesce(f.lag(x, k), F.lit(0.0)) * (a * r**k) if k else x * a
                    for k in range(ema_reach(a))
                ]
                total = terms[0]
                for t in terms[1:]:
                    total = total + t
                first[f"_ema{self.stem or self.base}{i}"] = total
                value = F.col(f"_ema{self.stem or self.base}{i}")
            else:
                tag = f"{self.stem or self.base}{i}"
                weighted = x * F.pow(F.lit(r), -pos)
                to_end = x * F.pow(F.lit(r), (self.run_rows - 1) - pos)
                first[f"_in{tag}"] = f.in_run(F.sum(weighted), "_run")
                handed[f"_past{tag}"] = f.previous_run(F.sum(to_end), "_run")
                value = a * F.pow(F.lit(r), pos) * F.col(f"_in{tag}") + a * F.pow(
                    F.lit(r), pos + 1
                ) * F.coalesce(F.col(f"_past{tag}"), F.lit(0.0))
            if self.adjust:
                value = value / (1 - F.pow(F.lit(r), F.col("seq") + 1))
            second[self._name(a)] = value
        return [first, handed, second]


SLOW_RUN_ROWS = 65_536  # longer runs are not held in one window; see slow_ema


def slow_ema(
    sig: Signal,
    alphas: Sequence[float],
    adjust: bool = False,
    base: str = "OptPow",
    run_rows: int = 8192,
) -> DataFrame:
    """The averages of ``Ema`` for factors so small that they reach back over many runs.

    Each run of rows is summed up to one number, the sums are handed to all
    later runs they still matter for, and every row adds its run's share by an
    equi-join. Returns the keys, ``seq``, the signal and the averages.
    """
    if max(alphas) >= 1:
        raise ValueError("a factor of 1 is the signal itself")
    # The weights inside a run must stay within the range of a double.
    run_rows = min(run_rows, *(max(1, int(600 / -log(1 - a))) for a in alphas))
    keys, x = list(sig.keys), F.col(base)
    out = sig.df.select(*keys, "seq", base).withColumn("_run", F.floor(F.col("seq") / run_rows))
    pos, by_run = F.col("seq") % run_rows, [*keys, "_run"]
    family = Ema(tuple(alphas), adjust, base)
    start = {
        a: x if adjust else F.when(F.col("seq") == 0, x / a).otherwise(x) for a in alphas
    }
    ends = out.groupBy(*by_run).agg(
        *[
            F.sum(start[a] * F.pow(F.lit(1 - a), (run_rows - 1) - pos)).alias(f"_c{i}")
            for i, a in enumerate(alphas)
        ]
    )
    runs = max(ceil(ema_reach(a) / run_rows) for a in alphas)
    handed = ends.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    handed = handed.withColumn("_run", F.col("_run") + F.col("_j")).groupBy(*by_run).agg(
        *[
            F.sum(F.col(f"_c{i}") * F.pow(F.lit(1 - a), (F.col("_j") - 1) * run_rows)).alias(f"_h{i}")
            for i, a in enumerate(alphas)
        ]
    )
    frame, zero = Frame(by_run, ["seq"]), F.lit(0.0)
    inside = {
        f"_in{i}": frame.running(F.sum(start[a] * F.pow(F.lit(1 - a), -pos)))
        for i, a in enumerate(alphas)
    }
    out = out.withColumns(inside).join(handed, by_run, "left")
    for i, (a, name) in enumerate(zip(alphas, family.names())):
        r = F.lit(1 - a)
        before = F.coalesce(F.col(f"_h{i}"), zero)
        value = a * F.pow(r, pos) * F.col(f"_in{i}") + a * F.pow(r, pos + 1) * before
        out = out.withColumn(name, value / (1 - F.pow(r, F.col("seq") + 1)) if adjust else value)
    return out.select(*keys, "seq", base, *family.names())


@dataclass(frozen=True)
class RollingAcf:
    """Autocorrelation at ``lags`` over the ``window`` rows before the current one.

    ``wrapped`` pairs w[j] with w[(j - lag) mod n] for j < n - lag, so ``lag``
    pairs run around the window's ends; ``valid`` pairs each value with the one
    ``lag`` rows earlier. Rows with fewer than ``window`` predecessors, windows
    without variance and windows with a missing value (null or NaN) give 0.

    Sums over a frame are differences of running sums of the block, which is
    centred first to keep cancellation small.
    """

    lags: tuple[int, ...] = (1, 5, 10, 20)
    window: int = 100
    mode: str = "wrapped"
    base: str = "OptPow"

    def __post_init__(self):
        if self.mode not in ("wrapped", "valid"):
            raise ValueError(f"unknown autocorrelation mode: {self.mode}")
        if max(self.lags) * 2 >= self.window:
            raise ValueError("a lag must be shorter than half the window")

    def reach(self):
        return self.window + 2, 0

    def names(self):
        return [f"{self.base}_acf_lag{k}" for k in self.lags]

    def levels(self, f: Frame) -> Levels:
        n, zero = self.window, F.lit(0.0)
        clean = {"_acf_x": F.when(~is_missing(self.base), F.col(self.base))}
        x, c, m0 = F.col("_acf_x"), F.col("_acf_c"), F.col("_acf_m")
        products = {f"_acf_p{k}": k for k in self.lags}
        if self.mode == "wrapped":
            products |= {f"_acf_w{k}": n - k for k in self.lags}
        pairs = sorted(set(products.values()))
        centre = {"_acf_m": f.whole(F.avg(x))} | shifted(f, "_acf_x", [1, *pairs])
        at = lambda k: F.col(_at("_acf_x", k))
        local = {"_acf_c": x - m0, "_acf_step": F.when(x != at(1), 1.0).otherwise(zero)}
        local |= {f"_acf_l{k}": F.coalesce((x - m0) * (at(k) - m0), zero) for k in pairs}
        sums = {
            "_acf_s": f.running(F.sum(c)),
            "_acf_q": f.running(F.sum(c * c)),
            "_acf_d": f.running(F.sum("_acf_step")),
            "_acf_z": f.running(F.sum(F.when(x.isNull(), 1.0).otherwise(zero))),
        }
        sums |= {name: f.running(F.sum(f"_acf_l{k}")) for name, k in products.items()}
        # All sums are looked up at once: one look back per distance.
        together = {"_acf_sums": F.struct(*sums)}
        reads: dict[str, Column] = {}

        def before(name: str, k: int) -> Column:
            then = F.col(_at("_acf_sums", k))
            return F.when(then.isNull(), zero).otherwise(then[name])

        def total(name: str, lo: int, hi: int) -> Column:
            """Sum over the rows i-lo .. i-hi (lo >= hi >= 1) from running sums."""
            reads.update(shifted(f, "_acf_sums", (hi, lo + 1)))
            return before(name, hi) - before(name, lo + 1)

        parts, spreads, ends = {"_acf_gaps": total("_acf_z", n, 1)}, {}, {}
        for k in self.lags:
            if self.mode == "wrapped":
                frames = {
                    "sa": total("_acf_s", n, k + 1),
                    "qa": total("_acf_q", n, k + 1),
                    "sb": total("_acf_s", k, 1) + total("_acf_s", n, 2 * k + 1),
                    "qb": total("_acf_q", k, 1) + total("_acf_q", n, 2 * k + 1),
                    "ab": total(f"_acf_w{k}", k, 1) + total(f"_acf_p{k}", n - k, k + 1),
                    "steps": total("_acf_d", n - 1, k + 1),
                }
            else:
                frames = {
                    "sa": total("_acf_s", n - k, 1),
                    "qa": total("_acf_q", n - k, 1),
                    "sb": total("_acf_s", n, k + 1),
                    "qb": total("_acf_q", n, k + 1),
                    "ab": total(f"_acf_p{k}", n - k, 1),
                    "steps": total("_acf_d", n - k - 1, 1),
                }
            parts |= {f"_acf_{name}{k}": col for name, col in frames.items()}
            of, m = (lambda name, k=k: F.col(f"_acf_{name}{k}")), n - k
            spreads[f"_acf_va{k}"] = of("qa") - of("sa") * of("sa") / m
            spreads[f"_acf_vb{k}"] = of("qb") - of("sb") * of("sb") / m
            floor = F.col("_acf_q") * 1e-14
            known = (F.col("seq") >= n) & (F.col("_acf_gaps") == 0) & (of("steps") > 0) & (of("va") > floor) & (of("vb") > floor)
            cov = of("ab") - of("sa") * of("sb") / m
            ends[f"{self.base}_acf_lag{k}"] = F.when(
                known, cov / F.sqrt(of("va") * of("vb"))
            ).otherwise(zero)
        return [clean, centre, local, sums, together, reads, parts, spreads, ends]


@dataclass(frozen=True)
class Trend:
    """Centred moving average, the residual and the residual's trailing deviation.

    An even window covers ``window/2`` rows before and ``window/2 - 1`` after.
    ``trailing=True`` uses past rows only.
    """

    window: int = 50
    trailing: bool = False
    base: str = "OptPow"

    def _frame(self):
        return (-(self.window - 1), 0) if self.trailing else (
            -(self.window // 2),
            (self.window - 1) // 2,
        )

    def reach(self):
        lo, hi = self._frame()
        return self.window - 1 - lo, hi

    def names(self):
        return [f"{self.base}_{s}" for s in ("trend", "residual", "residual_std")]

    def levels(self, f: Frame) -> Levels:
        trend, residual, std = self.names()
        x = F.col(self.base)
        return [
            {trend: f.over(F.avg(x), *self._frame())},
            {residual: x - F.col(trend)},
            {std: f.over(F.stddev_samp(residual), -(self.window - 1), 0)},
        ]


@dataclass(frozen=True)
class FastFading:
    """Signal over its centred moving mean (``window/2`` back, ``window/2 - 1`` ahead).

    The mean comes from running sums, so its cost does not grow with the window. Missing
    values (null or NaN) are left out of it.
    """

    window: int = 1000
    base: str = "OptPow"

    def reach(self):
        return self.window // 2 + 1, (self.window - 1) // 2

    def names(self):
        return [f"{self.base}_fading"]

    def levels(self, f: Frame) -> Levels:
        x = F.when(~is_missing(self.base), F.col(self.base))
        back, ahead = self.window // 2, (self.window - 1) // 2

        def between(name):
            # Past the last row the running sum stays at its final value.
            end = F.coalesce(f.lag(name, -ahead), F.col(f"{name}_all")) if ahead else F.col(name)
            return end - F.coalesce(f.lag(name, back + 1), F.lit(0))

        return [
            {
                "_ff_s": f.running(F.sum(x)),
                "_ff_n": f.running(F.count(x)),
                "_ff_s_all": f.whole(F.sum(x)),
                "_ff_n_all": f.whole(F.count(x)),
            },
            {self.names()[0]: F.try_divide(x, F.try_divide(between("_ff_s"), between("_ff_n")))},
        ]


def reach_of(families) -> tuple[int, int]:
    back, ahead = zip(*(fam.reach() for fam in families))
    return max(back), max(ahead)


def run_rows_of(families) -> int | None:
    return max((fam.run_rows for fam in families if isinstance(fam, Ema)), default=None)


def add_features(sig: Signal, families: Sequence, arrow=None, keep: Sequence[str] = ()) -> DataFrame:
    """Key columns, ``seq``, ``keep`` and the columns of all ``families``.

    ``arrow`` is an optional last family that needs whole blocks in Python (the
    spectrum); it runs on the same partitioning, after the windows.
    """
    every = [*families, *([arrow] if arrow else [])]
    back, ahead = reach_of(every)
    run = run_rows_of(families)
    emas = [fam for fam in families if isinstance(fam, Ema)]
    if any(fam.run_rows != run for fam in emas):
        raise ValueError("averages of one call must share a run length; call twice")
    if run and run > SLOW_RUN_ROWS:
        raise ValueError("these averages reach back too far for one window; use slow_ema")
    df, frame, own = spread(sig, back, ahead, run)
    plans = [fam.levels(frame) for fam in families]
    # Families that end in arithmetic go first and the rest as late as possible:
    # rows stay narrow, and no generated method holds all of the expressions.
    early = lambda fam: isinstance(fam, (Ema, RollingAcf))
    # They are done before the others begin, so that no window carries what only they read.
    depth = sum(max((len(p) for fam, p in zip(families, plans) if early(fam) is e), default=0) for e in (True, False))
    for i in range(depth):
        level = {}
        for fam, p in zip(families, plans):
            j = i if early(fam) else i - (depth - len(p))
            if 0 <= j < len(p):
                level |= p[j]
        df = df.withColumns({n: c for n, c in level.items() if n not in df.columns})
    names = [n for fam in families for n in fam.names()]
    first = [*sig.keys, "seq", *keep]
    if arrow:
        df = arrow.apply(df.withColumn("_own", own), frame, [*first, *names])
        return df.select(*first, *names, *arrow.names())
    return df.where(own).select(*first, *names)
