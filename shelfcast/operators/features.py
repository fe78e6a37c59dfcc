"""Calendar, lag, rolling, promotion and interaction features of a daily panel.

Series windows expect the daily grain: one row per (date, store, family). A series then has at most
one row per calendar day, which bounds every window group whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.columns import PANEL, PanelColumns
from shelfcast.functions.safe import correlation
from shelfcast.operators.ordering import with_lookback
from shelfcast.plans.durable import durable

LAGS = (1, 7, 14, 30, 91, 365)
PROMO_LAGS = (1, 7, 14)
WINDOWS = (7, 30, 90)
PROMO_WINDOWS = (7, 30)


@dataclass(frozen=True)
class SeriesStart:
    """What is known of a series whose first rows are not at hand: the number of those rows, the row numbers of the
    last promotion and of the last row without (0: none), and whether a row has all the rows that it looks back to."""

    rows: Column
    promo_row: Column
    plain_row: Column
    whole: Column


def series_window(df: DataFrame, cols: PanelColumns = PANEL):
    """Rows of one series by date. A table without the series keys raises: all its rows would be one group.

    Such tables have :func:`add_lags_ungrouped`.
    """
    missing = [c for c in cols.series if c not in df.columns]
    if missing:
        raise ValueError(f"no series keys {missing}; use add_lags_ungrouped for a table without series")
    return Window.partitionBy(*cols.series).orderBy(cols.date)


def trailing(window, rows: int, gap: int = 0):
    """``rows`` rows ending ``gap`` rows back: 0 includes the current row, 1 leaves it out."""
    return window.rowsBetween(-(rows - 1) - gap, -gap)


def grain_violations(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Keys that break the daily grain."""
    return df.groupBy(*cols.grain).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_daily_grain(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """The panel itself, after a check that no key of the daily grain repeats."""
    broken = grain_violations(df, cols).first()
    if broken is not None:
        raise ValueError(f"not one row per {cols.grain}: {broken}; sum with to_daily_grain first")
    return df


def to_daily_grain(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Sum the target and promotions to one row per (date, store, family)."""
    return df.groupBy(*cols.grain).agg(
        F.sum(cols.target).alias(cols.target), F.sum(cols.promo).alias(cols.promo)
    )


def densify(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Daily spine per series; days without a row get a null target and 0 promotions."""
    bounds = df.groupBy(*cols.series).agg(F.min(cols.date).alias("_a"), F.max(cols.date).alias("_b"))
    spine = bounds.select(
        *cols.series, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(cols.date)
    )
    return spine.join(df, cols.grain, "left").withColumn(
        cols.promo, F.coalesce(F.col(cols.promo), F.lit(0))
    )


# calendar ------------------------------------------------------------------------------------


def calendar_parts(d: Column) -> dict[str, Column]:
    """Year, month, day, Monday-based weekday, day of year, ISO week, quarter."""
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
    }


def calendar_flags(d: Column) -> dict[str, Column]:
    """Weekend, and start and end of month, quarter and year."""
    month_end = d == F.last_day(d)
    return {
        "is_weekend": F.weekday(d) >= 5,
        "is_month_start": F.dayofmonth(d) == 1,
        "is_month_end": month_end,
        "is_quarter_start": (F.dayofmonth(d) == 1) & (F.month(d) % 3 == 1),
        "is_quarter_end": month_end & (F.month(d) % 3 == 0),
        "is_year_start": F.dayofyear(d) == 1,
        "is_year_end": month_end & (F.month(d) == 12),
    }


def calendar_cycles(d: Column) -> dict[str, Column]:
    """Sine and cosine of month/12, weekday/7 and day of year/365."""
    cycles = (("month", F.month(d), 12), ("day_of_week", F.weekday(d), 7), ("day_of_year", F.dayofyear(d), 365))
    out = {}
    for name, part, length in cycles:
        angle = F.lit(2.0) * F.pi() * part / F.lit(float(length))
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out


def add_calendar(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """All twenty calendar columns, one projection."""
    d = F.col(cols.date)
    return df.withColumns({**calendar_parts(d), **calendar_flags(d), **calendar_cycles(d)})


# lags and rolling statistics -----------------------------------------------------------------


def lag_columns(window, cols: PanelColumns = PANEL, lags=LAGS, promo_lags=PROMO_LAGS) -> dict[str, Column]:
    """Target and promotion lags counted in rows."""
    out = {f"{cols.target}_lag_{k}": F.lag(cols.target, k).over(window) for k in lags}
    out.update({f"{cols.promo}_lag_{k}": F.lag(cols.promo, k).over(window) for k in promo_lags})
    return out


def rolling_columns(window, cols: PanelColumns = PANEL, windows=WINDOWS, gap: int = 0) -> dict[str, Column]:
    """Mean, sample std, min and max over trailing rows, from the first row on."""
    out = {}
    for n in windows:
        frame = trailing(window, n, gap)
        for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{cols.target}_rolling_{name}_{n}"] = fn(cols.target).over(frame)
    return out


def add_lags(df: DataFrame, cols: PanelColumns = PANEL, lags=LAGS, promo_lags=PROMO_LAGS) -> DataFrame:
    if cols.promo not in df.columns:
        promo_lags = ()
    return df.withColumns(lag_columns(series_window(df, cols), cols, lags, promo_lags))


def add_rolling(df: DataFrame, cols: PanelColumns = PANEL, windows=WINDOWS, gap: int = 0,
                fill: bool = True) -> DataFrame:
    """Rolling statistics; ``fill`` carries the last known value forward inside the series.

    With ``gap=0`` the current target is part of its own features; models use a gap of at least 1.
    """
    window = series_window(df, cols)
    rolled = df.withColumns(rolling_columns(window, cols, windows, gap))
    return fill_forward(rolled, [c for c in rolled.columns if c not in df.columns], cols) if fill else rolled


def _joined(earlier: str, later: str) -> Column:
    """Moments and bounds of two neighbouring stretches of rows; a missing stretch has no rows."""
    a, b = ({f: F.col(c)[f] for f in ("n", "total", "m2", "lo", "hi")} for c in (earlier, later))
    na, nb = (F.coalesce(x["n"], F.lit(0)) for x in (a, b))
    both = (na > 0) & (nb > 0)
    delta = b["total"] / nb - a["total"] / na
    spread = F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0))
    return F.struct(
        (na + nb).alias("n"),
        F.when(both, a["total"] + b["total"]).otherwise(F.coalesce(a["total"], b["total"])).alias("total"),
        F.when(both, spread + delta * delta * na * nb / (na + nb)).otherwise(spread).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"),
        F.greatest(a["hi"], b["hi"]).alias("hi"),
    )


def add_rolling_wide(df: DataFrame, cols: PanelColumns = PANEL, windows=(365,), gap: int = 0) -> DataFrame:
    """The columns of :func:`rolling_columns` for wide windows, at a cost that grows with the logarithm of the width.

    Stretches of 1, 2, 4, ... rows up to each row are joined pair by pair, and a window is the few
    stretches that add up to its width. Frames in turn read every row of the window for every row.
    Everything shares one partitioning and order. Unknown values are left out, as in frames.
    """
    window, kept = series_window(df, cols), df.columns
    y = F.col(cols.target).cast("double")
    known = y.isNotNull()
    one = F.struct(known.cast("long").alias("n"), y.alias("total"), F.when(known, 0.0).alias("m2"), y.alias("lo"), y.alias("hi"))
    out, level, width = df.withColumn("_s0", one), 0, max(windows)
    while 2 << level <= width:
        back = out.withColumn("_back", F.lag(f"_s{level}", 1 << level).over(window))
        out = back.withColumn(f"_s{level + 1}", _joined("_back", f"_s{level}")).drop("_back")
        level += 1
    parts, names = {}, {}
    for n in windows:
        offset = gap
        names[n] = []
        for k in range(level + 1):
            if n >> k & 1:
                name = f"_w{n}_{k}"
                parts[name] = F.lag(f"_s{k}", offset).over(window) if offset else F.col(f"_s{k}")
                names[n].append(name)
                offset += 1 << k
    out = out.withColumns(parts).drop(*[f"_s{k}" for k in range(level + 1)])
    found = {}
    for n, (latest, *earlier) in names.items():
        for name in earlier:
            out = out.withColumn(latest, _joined(name, latest)).drop(name)
        w = F.col(latest)
        found |= {
            f"{cols.target}_rolling_mean_{n}": w["total"] / F.nullif(w["n"], F.lit(0)),
            f"{cols.target}_rolling_std_{n}": F.when(w["n"] > 1, F.sqrt(w["m2"] / (w["n"] - 1))),
            f"{cols.target}_rolling_min_{n}": w["lo"],
            f"{cols.target}_rolling_max_{n}": w["hi"],
        }
    return out.select(*[F.col(c) for c in kept if c not in found], *[v.alias(c) for c, v in found.items()])


def filled_columns(window, columns, start: SeriesStart | None = None) -> dict[str, Column]:
    """Last known value of each column along the window; with a start, of the rows that are whole."""
    seen = {c: F.when(start.whole, F.col(c)) if start else F.col(c) for c in columns}
    return {c: F.last(v, ignorenulls=True).over(window) for c, v in seen.items()}


def fill_forward(df: DataFrame, columns, cols: PanelColumns = PANEL) -> DataFrame:
    """Last known value inside the series."""
    return df.withColumns(filled_columns(series_window(df, cols), columns))


def add_lags_ungrouped(df: DataFrame, order, cols: PanelColumns = PANEL, lags=LAGS, windows=WINDOWS) -> DataFrame:
    """Lags and rolling means over the whole table, for tables without series keys.

    ``order`` must be total. The rows are worked on in chunks with enough earlier rows, so no task
    sees the whole table.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]

    def build(window):
        lagged = [F.lag(cols.target, k).over(window).alias(f"{cols.target}_lag_{k}") for k in lags]
        means = [
            F.avg(cols.target).over(trailing(window, n)).alias(f"{cols.target}_rolling_mean_{n}") for n in windows
        ]
        return lagged + means

    return with_lookback(df, order, max([*lags, *windows]), build)


# promotions ----------------------------------------------------------------------------------


def promo_columns(window, cols: PanelColumns = PANEL, windows=PROMO_WINDOWS) -> dict[str, Column]:
    """Trailing promotion frequency, next and previous day's promotion (0 when there is none)."""
    out = {f"promo_frequency_{n}d": F.avg(cols.promo).over(trailing(window, n)) for n in windows}
    out["promo_next_day"] = F.coalesce(F.lead(cols.promo, 1).over(window), F.lit(0))
    out["promo_prev_day"] = F.coalesce(F.lag(cols.promo, 1).over(window), F.lit(0))
    return out


def run_columns(window, row: str, cols: PanelColumns = PANEL, any_positive: bool = False,
                start: SeriesStart | None = None) -> dict[str, Column]:
    """Rows since the last promotion and running promotion streak, from the row number in ``row``."""
    on_promo = (F.col(cols.promo) > 0) if any_positive else (F.col(cols.promo) == 1)
    on_promo = F.coalesce(on_promo, F.lit(False))
    last_promo = F.max(F.when(on_promo, F.col(row))).over(window)
    last_plain = F.max(F.when(~on_promo, F.col(row))).over(window)
    if start:
        last_promo, last_plain = F.greatest(last_promo, start.promo_row), F.greatest(last_plain, start.plain_row)
    return {
        "days_since_promo": (F.col(row) - F.coalesce(last_promo, F.lit(0))).cast("long"),
        "promo_streak": (F.col(row) - F.coalesce(last_plain, F.lit(0))).cast("long"),
    }


def add_promo_runs(df: DataFrame, cols: PanelColumns = PANEL, any_positive: bool = False) -> DataFrame:
    """Rows since the last promotion and length of the running promotion streak.

    A promotion is a count of exactly 1, or any positive count with ``any_positive``. Both follow
    from row numbers: the current one minus that of the last promotion, or of the last row without.
    Everything shares one window, so no further shuffle or sort is needed.
    """
    window = series_window(df, cols)
    numbered = df.withColumn("_row", F.row_number().over(window))
    return numbered.withColumns(run_columns(window, "_row", cols, any_positive)).drop("_row")


def add_promotions(df: DataFrame, cols: PanelColumns = PANEL, any_positive: bool = False) -> DataFrame:
    return add_promo_runs(df.withColumns(promo_columns(series_window(df, cols), cols)), cols, any_positive)


# interactions --------------------------------------------------------------------------------


def add_interactions(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Products of promotions and the index with calendar flags; needs :func:`add_calendar`."""
    out = {}
    weekend, month_end = F.col("is_weekend").cast("int"), F.col("is_month_end").cast("int")
    if cols.promo in df.columns:
        promo = F.col(cols.promo)
        holiday = F.col("is_holiday") if "is_holiday" in df.columns else F.lit(0)
        out.update(promo_weekend=promo * weekend, promo_month_end=promo * month_end, promo_holiday=promo * holiday)
    if "dcoilwtico" in df.columns:
        index = F.col("dcoilwtico")
        out.update(oil_weekend=index * weekend, oil_month=index * F.col("month"))
    return df.withColumns(out) if out else df


def series_mean(window, cols: PanelColumns = PANEL) -> Column:
    """Mean target of the whole series. Carries the window's order, so it joins the same window pass."""
    return F.avg(cols.target).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def add_series_mean(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Mean target of the series on every row."""
    return df.withColumn("store_family_mean_sales", series_mean(series_window(df, cols), cols))


def apply_series_mean(df: DataFrame, training: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Series means learnt on a training slice and joined to other rows, so nothing leaks.

    The means are one row per series; stored, they are broadcast only while they are small.
    """
    means = training.groupBy(*cols.series).agg(F.avg(cols.target).alias("store_family_mean_sales"))
    return df.join(durable(means), cols.series, "left")


def feature_relevance(df: DataFrame, columns, target: str = "sales") -> DataFrame:
    """Absolute correlation of each column with the target, largest first; one pass."""
    one = df.agg(*[F.abs(correlation(F.col(c), F.col(target))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("relevance")) for c in columns])
    return one.select(F.explode(pairs).alias("_p")).select("_p.*").orderBy(
        F.col("relevance").desc_nulls_last(), "feature"
    )
