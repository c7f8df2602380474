"""Column functions."""

from .keyed import gumbel, laplace, token, uniform
from .normal import normal_cdf, normal_quantile

__all__ = ["gumbel", "laplace", "normal_cdf", "normal_quantile", "token", "uniform"]
