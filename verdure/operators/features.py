"""Lag, rolling and window features over sensor series.

All take the key and order columns of the series and share one window specification per call, so
any number of features costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.operators.joins import lookup_join
from verdure.operators.ordered import Over, windowed

# Drivers, lag steps and rolling widths of the feature table.
LAG_DRIVERS = ("ta", "rh", "vpd", "sw_in", "ws", "precip", "swc_shallow", "ppfd_in")
ROLLING_DRIVERS = ("ta", "vpd", "sw_in", "rh")
LAGS = (1, 2, 3, 6, 12, 24)
ROLLING_WIDTHS = (3, 6, 12, 24, 48, 72)

EPSILON = 1e-6
# Length of a span of a time-based window, in widest windows; 1/8 of the rows are seen twice.
_SPAN_WINDOWS = 8
_HOUR = 3600 * 1_000_000


def lag_columns(
    over: Over, have: Sequence[str], drivers: Sequence[str], lags: Sequence[int], max_lag: int | None = None
) -> list[str]:
    """``<driver>_lag_<k>h`` for every driver and step; a driver the table lacks gives null columns."""
    kept = [k for k in lags if max_lag is None or k <= max_lag]
    value = lambda d, k: f"lag(`{d}`, {k}) {over}" if d in have else "CAST(NULL AS DOUBLE)"
    return [f"{value(d, k)} AS `{d}_lag_{k}h`" for d in drivers for k in kept]


def _parts_of(width: int, ready: Sequence[int]) -> list[int]:
    """Greatest widths of ``ready`` first, adding up to ``width``."""
    parts = []
    for r in sorted(ready, reverse=True):
        while width >= r:
            parts.append(r)
            width -= r
    return parts


def _chain(widths: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Every width as a sum of few smaller ones, doubling from 1 where the given widths are far apart.

    3, 6, 12, 24, 48, 72 become 1+1+1, 3+3, 6+6, 12+12, 24+24 and 48+24.
    """
    ready, steps = [1], []
    for width in sorted(set(widths) - {1}):
        step = 2 * max(r for r in ready if 2 * r <= width)
        while len(_parts_of(width, ready)) > 3 and step <= width:
            if step not in ready:
                steps.append((step, [step // 2, step // 2]))
                ready.append(step)
            step *= 2
        steps.append((width, _parts_of(width, ready)))
        ready.append(width)
    return steps


def add_rolling(
    df: DataFrame, over: Over, drivers: Sequence[str], widths: Sequence[int], stats: Sequence[str]
) -> DataFrame:
    """``<driver>_<stat>_<w>h`` over the last ``w`` rows, nulls skipped; std is the sample deviation.

    A sliding frame adds up all its rows again for every row. Here the state of a window (count, sum,
    squared deviations) is put together from the states of two or three shorter windows that lie end
    to end, read with ``lag``. States are only ever added, never subtracted, so nothing is lost to
    rounding, and the work per row does not grow with the width.
    """
    columns = list(df.columns)
    have = [d for d in drivers if d in columns]
    parts = ["n", "s", "m"] if "std" in stats else ["n", "s"]
    number = {d: i for i, d in enumerate(drivers)}
    state = lambda d, width, part, back=0: f"`_{part}{number[d]}_{width}_{back}`"

    if have:
        first = []
        for d in have:
            first.append(f"CASE WHEN `{d}` IS NULL THEN 0D ELSE 1D END AS {state(d, 1, 'n')}")
            first.append(f"coalesce(CAST(`{d}` AS DOUBLE), 0D) AS {state(d, 1, 's')}")
            first.append(f"0D AS {state(d, 1, 'm')}")
        df = df.selectExpr("*", *first)
    for width, pieces in _chain(widths) if have else []:
        # the shorter windows further back, as they stood that many rows ago
        earlier = [(piece, sum(pieces[:i])) for i, piece in enumerate(pieces) if i]
        df = df.selectExpr(
            "*",
            *[
                f"lag({state(d, piece, p)}, {back}, 0D) {over} AS {state(d, piece, p, back)}"
                for d in have
                for piece, back in earlier
                for p in parts
            ],
        )
        made = []
        for d in have:
            n, total, deviation = (state(d, pieces[0], p) for p in "nsm")
            for piece, back in earlier:
                n2, total2, deviation2 = (state(d, piece, p, back) for p in "nsm")
                apart = f"({total2} / greatest({n2}, 1D) - ({total}) / greatest({n}, 1D))"
                share = f"({n}) * {n2} / greatest({n} + {n2}, 1D)"
                deviation = f"{deviation} + {deviation2} + {apart} * {apart} * {share}"
                n, total = f"{n} + {n2}", f"{total} + {total2}"
            merged = {"n": n, "s": total, "m": deviation}
            made += [f"{merged[p]} AS {state(d, width, p)}" for p in parts]
        df = df.selectExpr("*", *made)
    out = []
    for d in drivers:
        for w in widths:
            n, total, deviation = (state(d, w, p) for p in "nsm")
            values = {
                "mean": f"CASE WHEN {n} > 0 THEN {total} / {n} END",
                "sum": f"CASE WHEN {n} > 0 THEN {total} END",
                "std": f"CASE WHEN {n} > 1 THEN sqrt({deviation} / ({n} - 1)) END",
            }
            for stat in stats:
                out.append(f"{values[stat] if d in have else 'CAST(NULL AS DOUBLE)'} AS `{d}_{stat}_{w}h`")
    return df.selectExpr(*[f"`{c}`" for c in columns], *out)


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    drivers: Sequence[str] = LAG_DRIVERS,
    lags: Sequence[int] = LAGS,
    max_lag: int | None = None,
    **size,
) -> DataFrame:
    """Row lags; a lag never crosses from one series into the next."""
    add = lambda rows, w: rows.selectExpr("*", *lag_columns(w, df.columns, drivers, lags, max_lag))
    return windowed(df, keys, order, add, max(lags), **size)


def rolling_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    drivers: Sequence[str] = ROLLING_DRIVERS,
    widths: Sequence[int] = ROLLING_WIDTHS,
    stats: Sequence[str] = ("mean", "std"),
    **size,
) -> DataFrame:
    """Rolling statistics over the last rows of the series, the current row included."""
    add = lambda rows, w: add_rolling(rows, w, drivers, widths, stats)
    return windowed(df, keys, order, add, max(widths), **size)


def series_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lag_drivers: Sequence[str] = LAG_DRIVERS,
    rolling_drivers: Sequence[str] = ROLLING_DRIVERS,
    lags: Sequence[int] = LAGS,
    widths: Sequence[int] = ROLLING_WIDTHS,
    **size,
) -> DataFrame:
    """Lags and rolling statistics together over one exchange and one sort."""

    def add(rows: DataFrame, over: Over) -> DataFrame:
        lagged = rows.selectExpr("*", *lag_columns(over, df.columns, lag_drivers, lags))
        return add_rolling(lagged, over, rolling_drivers, widths, ("mean", "std"))

    return windowed(df, keys, order, add, max([*lags, *widths]), **size)


def time_features(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    drivers: Sequence[str],
    hours: Sequence[int] = (),
    stats: Sequence[str] = ("mean", "std"),
    lags: Sequence[int] = (),
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Lags and rolling statistics by the clock instead of by rows, one row per series and timestamp.

    ``<driver>_lag_<k>h`` is the value exactly ``k`` hours earlier, null where there is none; of several rows at that time
    their mean. ``<driver>_mean_<h>h`` and ``<driver>_std_<h>h`` (sample deviation) cover the trailing hours
    ``(t - h, t]``, nulls skipped. A driver the table lacks gives null columns.

    Rows sharing a timestamp share the answer, so they become one state (count, sum, squared deviations) first. The
    series is then cut into spans of several widest windows; each span also sees the last window of the span before
    it, which is all a trailing window can reach. A task sorts the distinct timestamps of one span. States are added
    about the mean of their span, so that large values lose no digits.

    ``since`` (inclusive) and ``until`` (exclusive) restrict the answer; the time filter reaches the
    scan with the widest window as margin, so that the first answers are whole.
    """
    widest = max([*hours, *lags])
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since - timedelta(hours=widest)))
    if until is not None:
        df = df.where(F.col(ts) < F.lit(until))
    have = [d for d in drivers if d in df.columns]
    number = {d: i for i, d in enumerate(have)}
    column = lambda name, d: f"_{name}{number[d]}"
    spread = "std" in stats and bool(hours)
    parts = [F.count(F.lit(1)).alias("_rows")]
    for d in have:
        value = F.col(d).cast("double")
        parts += [F.count(d).alias(column("n", d)), F.avg(value).alias(column("mean", d))]
        if spread:
            parts.append((F.var_pop(value) * F.count(d)).alias(column("dev", d)))
    per_time = df.groupBy(*keys, ts).agg(*parts)
    reach = widest * _HOUR
    span = _SPAN_WINDOWS * reach
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    within = F.pmod("_us", F.lit(span))
    # a whole number of spans, so the division is exact
    own = ((F.col("_us") - within) / F.lit(span)).cast("bigint")
    placed = per_time.withColumn("_us", micros).withColumn("_own", own)
    near_end = within >= span - reach
    spans = F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))
    copied = placed.withColumn("_span", F.explode(spans))
    series = Window.partitionBy(*keys, "_span")
    spec = series.orderBy("_us")
    centre = {d: F.avg(column("mean", d)).over(series) for d in have}
    copied = copied.select("*", *[c.alias(column("mid", d)) for d, c in centre.items()])
    sums, out = [], []
    for d in drivers:
        if d not in have:
            names = [f"{d}_lag_{k}h" for k in lags] + [f"{d}_{s}_{h}h" for s in stats for h in hours]
            out += [F.lit(None).cast("double").alias(n) for n in names]
            continue
        n, mid = F.col(column("n", d)), F.col(column("mid", d))
        off = F.col(column("mean", d)) - mid
        for k in lags:
            at = spec.rangeBetween(-k * _HOUR, -k * _HOUR)
            out.append(F.max(column("mean", d)).over(at).alias(f"{d}_lag_{k}h"))
        for h in hours:
            frame = spec.rangeBetween(1 - h * _HOUR, 0)
            mine = lambda name, d=d, h=h: f"{column(name, d)}_{h}"
            sums += [F.sum(n).over(frame).alias(mine("n")), F.sum(n * off).over(frame).alias(mine("s"))]
            total, count = F.col(mine("s")), F.col(mine("n"))
            if "mean" in stats:
                out.append((mid + F.try_divide(total, count)).alias(f"{d}_mean_{h}h"))
            if spread:
                sums.append(F.sum(F.col(column("dev", d)) + n * off * off).over(frame).alias(mine("q")))
                squared = F.greatest(F.col(mine("q")) - F.try_divide(total * total, count), F.lit(0.0))
                out.append(F.when(count > 1, F.sqrt(squared / (count - 1))).alias(f"{d}_std_{h}h"))
    done = copied.select("*", *sums).select("*", *out).where(F.col("_span") == F.col("_own"))
    if since is not None:
        done = done.where(F.col(ts) >= F.lit(since))
    names = [f"{d}_lag_{k}h" for d in drivers for k in lags] + [f"{d}_{s}_{h}h" for s in stats for d in drivers for h in hours]
    return done.select(*keys, ts, *names)


def lag_time(df: DataFrame, keys: Sequence[str], ts: str, drivers: Sequence[str] = LAG_DRIVERS, lags: Sequence[int] = LAGS) -> DataFrame:
    """Values exactly so many hours earlier, one row per series and timestamp."""
    return time_features(df, keys, ts, drivers, lags=lags, stats=())


def rolling_mean_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    drivers: Sequence[str],
    hours: Sequence[int],
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Mean over the trailing ``h`` hours, ``(t - h, t]``, one row per series and timestamp."""
    return time_features(df, keys, ts, drivers, hours, ("mean",), (), since, until)


def rolling_std_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    drivers: Sequence[str],
    hours: Sequence[int],
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Sample deviation over the trailing ``h`` hours, ``(t - h, t]``, one row per series and timestamp."""
    return time_features(df, keys, ts, drivers, hours, ("std",), (), since, until)


def rolling_slope(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], driver: str, width: int, **size
) -> DataFrame:
    """Least-squares slope of the driver against row position over the last ``width`` rows.

    Uses the distance to the current row as position, which leaves the slope unchanged and needs no
    numbering of the series.
    """

    def add(rows: DataFrame, over: Over) -> DataFrame:
        x = [F.lit(float(-k)) for k in range(width)]
        y = [F.col(driver) if k == 0 else F.expr(f"lag(`{driver}`, {k}) {over}") for k in range(width)]
        has = [F.when(v.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)) for v in y]
        val = [F.coalesce(v, F.lit(0.0)) for v in y]
        n = sum(has[1:], has[0])
        sx = sum((a * h for a, h in zip(x[1:], has[1:])), x[0] * has[0])
        sy = sum(val[1:], val[0])
        sxy = sum((a * v for a, v in zip(x[1:], val[1:])), x[0] * val[0])
        sxx = sum((a * a * h for a, h in zip(x[1:], has[1:])), x[0] * x[0] * has[0])
        slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
        return rows.select("*", slope.alias(f"{driver}_slope_{width}h"))

    return windowed(df, keys, order, add, width - 1, **size)


def precipitation_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], precip: str = "precip", **size
) -> DataFrame:
    """Rain of the row before (0 at the start), sums over 6 and 24 rows, share of the 6-row sum."""

    def add(rows: DataFrame, over: Over) -> DataFrame:
        return rows.selectExpr(
            "*",
            f"coalesce(lag(`{precip}`, 1) {over}, 0D) AS recent_precip_1h",
            f"sum(`{precip}`) {over.last(6)} AS recent_precip_6h",
            f"sum(`{precip}`) {over.last(24)} AS recent_precip_24h",
            f"`{precip}` / (sum(`{precip}`) {over.last(6)} + {EPSILON}D) AS precip_intensity",
        )

    return windowed(df, keys, order, add, 23, **size)


def relative_to_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Value over the greatest value of its group; the maxima are combined map-side, then joined back."""
    tops = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    joined = lookup_join(df, tops, keys, "left", derived=True)
    return joined.withColumn(out, F.col(value) / (F.col("_top") + F.lit(EPSILON))).drop("_top")
