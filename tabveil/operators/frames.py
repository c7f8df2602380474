"""The table functions in curried form, for DataFrame.transform() and, on request, as methods of a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

from . import sequences, transformers

Step = Callable[[DataFrame], DataFrame]


def _curried(f: Callable[..., DataFrame]) -> Callable[..., Step]:
    """f without its table: called with the rest, it gives a step for DataFrame.transform()."""

    @wraps(f)
    def outer(*args, **named) -> Step:
        return lambda df: f(df, *args, **named)

    return outer


#: The functions by name; each takes a table first.
FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        transformers.bin_numeric, transformers.sample_from_bins, transformers.replace_rare, transformers.group_rare, transformers.generalize, transformers.specialize, transformers.pseudonyms,
        transformers.add_ids, transformers.generalize_dates, transformers.restore_dates, sequences.flatten_records, sequences.unflatten_records, sequences.consistent_sequences,
    )
}

#: The same as steps: df.transform(STEPS["bin_numeric"]("x", 5)).
STEPS: dict[str, Callable[..., Step]] = {name: _curried(f) for name, f in FUNCTIONS.items()}


def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A decorator for a function of one's own, which is then among the steps by its name."""
    if f.__name__ in FUNCTIONS:
        raise ValueError(f"there is a step {f.__name__} already")
    FUNCTIONS[f.__name__], STEPS[f.__name__] = f, _curried(f)
    return f


def attach(*names: str) -> None:
    """Makes the named functions, or all, methods of every DataFrame; none that it has already is replaced."""
    for name in names or FUNCTIONS:
        if hasattr(DataFrame, name) and getattr(DataFrame, name) is not FUNCTIONS[name]:
            raise ValueError(f"a DataFrame has {name} already")
        setattr(DataFrame, name, FUNCTIONS[name])
