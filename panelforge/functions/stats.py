"""Column expressions for statistics that Spark lacks or defines otherwise.

Spark 4 raises on a division by zero and on the correlation of a constant; everything here gives null
instead.  NaN is a value in Spark, so sources turn it into null first (no_nan).
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    """A ticker's rows by date: the one window that most operators share, so that Spark sorts once."""
    return Window.partitionBy("ticker").orderBy("date")


def last_rows(k: int) -> WindowSpec:
    return by_date().rowsBetween(-(k - 1), 0)


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson over rows that have both; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)]
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return F.try_divide(cov, sx * sy)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected; 0 for a constant, null below three values."""
    n = F.count(c)
    g = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Excess, bias-corrected; 0 for a constant, null below four values."""
    n = F.count(c).cast("double")
    g = F.kurtosis(c)
    return F.when(n >= 4, F.when(g.isNull(), 0.0).otherwise(F.try_divide(((n + 1) * g + 6) * (n - 1), (n - 2) * (n - 3))))


def jarque_bera_p(c: Column, least: int = 8) -> Column:
    """The p-value: chi-square with two degrees of freedom has a closed form."""
    n = F.count(c)
    statistic = n / 6 * (F.pow(F.skewness(c), F.lit(2.0)) + F.pow(F.kurtosis(c), F.lit(2.0)) / 4)
    return F.when(n >= least, F.exp(-statistic / 2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# The coefficients of Wichura's algorithm AS 241 (1988), from the highest power down; the
# middle, the tails up to sqrt(-ln p) = 5, the tails beyond.
MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def interval_z(level: float) -> float:
    """Half the width of a central interval of this level, in standard deviations."""
    return normal_quantile(0.5 + level / 2)
