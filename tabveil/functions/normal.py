"""The normal distribution as column arithmetic: Spark has neither its distribution function nor the inverse."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Rational approximations of the quantile (Wichura, algorithm AS 241) from the highest power down, by
# the distance of p from one half: the centre, the near tail, the far tail; good to 16 digits.
CENTRE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
          [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
NEAR = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
        [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])
FAR = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
       [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0])
# The ratio that exp(-x * x / 2) is multiplied by up to a distance of ENDS (Hart), from the highest power down.
HART = ([0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376],
        [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752])
ENDS = 7.07106781186547


def _ratio(parts: tuple[list[float], list[float]], x: Column) -> Column:
    """The quotient of two polynomials."""
    up, down = (F.lit(p[0]) for p in parts)
    for c in parts[0][1:]:
        up = up * x + c
    for c in parts[1][1:]:
        down = down * x + c
    return up / down


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to 1e-14; NULL stays."""
    far = F.abs(x)
    tail = F.when(far < ENDS, F.exp(-far * far / 2) * _ratio(HART, far))
    step = far + 0.65
    for k in (4, 3, 2, 1):
        step = far + F.lit(float(k)) / step
    tail = tail.when(far < 37, F.exp(-far * far / 2) / step / 2.506628274631).when(far >= 37, 0.0)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The inverse of the standard normal distribution function for 0 < p < 1; NULL stays."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(NEAR, r - 1.6)).otherwise(_ratio(FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
