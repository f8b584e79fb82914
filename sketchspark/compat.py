"""What a state's rows were built with, as metadata of their last column.

Column metadata goes with a column through selects, filters, unions, Parquet and streams, and
costs nothing at run time.  Merges, probes and estimates compare it; a state without it (rows
of a foreign origin) is taken as its caller describes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .errors import IncompatibleSketches

KEY = "sketch"


def stamp(state: DataFrame, **built: object) -> DataFrame:
    return state.withMetadata(state.columns[-1], {KEY: built})


def built_with(state: DataFrame) -> dict[str, object]:
    """The parameters that are known of a state."""
    return next((dict(f.metadata[KEY]) for f in state.schema.fields if KEY in f.metadata), {})


def compatible(a: DataFrame, b: DataFrame) -> bool:
    """Whether two states may be merged, as far as their parameters are known."""
    x, y = built_with(a), built_with(b)
    return all(x[k] == y[k] for k in x.keys() & y.keys())


def agreed(states: Sequence[DataFrame], **asked: object) -> dict[str, object]:
    """The parameters that all states share and that agree with those asked for; raises if any differ."""
    out = dict(asked)
    for state in states:
        for k, v in built_with(state).items():
            if out.setdefault(k, v) != v:
                raise IncompatibleSketches(f"{k}: {out[k]} and {v}")
    return out
