"""Extension points: named transforms, chains of them, and models that run over waveforms in Arrow batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

_transforms: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a DataFrame function under a name."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _transforms:
            raise ValueError(f"{name} is taken")
        _transforms[name] = f
        return f

    return keep


def chain(rows: DataFrame, steps: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Apply registered transforms one after the other."""
    for name, options in steps:
        rows = rows.transform(_transforms[name], **options)
    return rows


def toggles(known: dict[str, bool], chosen: dict[str, bool]) -> dict[str, bool]:
    """Rule switches with their defaults; unknown names are ignored with a warning."""
    for name in chosen.keys() - known.keys():
        warnings.warn(f"unknown rule {name}", stacklevel=2)
    return {name: chosen.get(name, default) for name, default in known.items()}


def predict(waves: DataFrame, make_model: Callable[[], Callable[[list], list]], schema: str = "record long, y double") -> DataFrame:
    """Run a model over (record, x); each task makes the model once and feeds it batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            yield pd.DataFrame({"record": frame["record"], "y": model(frame["x"].to_list())})

    return waves.select("record", "x").mapInPandas(run, schema)


def route(leads: set[str]) -> str:
    """The model for a set of leads: II is needed, with V1 and V6 three leads are used."""
    if "II" not in leads:
        raise ValueError("lead II is needed")
    return "three" if {"II", "V1", "V6"} <= leads else "one"
