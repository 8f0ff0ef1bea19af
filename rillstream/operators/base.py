"""What a feature group is: window columns it needs, aggregates over a session, and columns made of those."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..config import Config

Columns = dict[str, Column]


def nothing(df: DataFrame, cfg: Config) -> DataFrame:
    return df


@dataclass(frozen=True)
class Group:
    """``prepare`` adds packet columns; ``aggregate`` gives aggregates by name; ``finish`` gives the features, which may use the aggregates of all groups' own names.

    ``optional`` names the features that no profile holds and that an option turns on. ``needs`` names groups whose ``prepare`` comes first.
    """

    name: str
    tier: str
    aggregate: Callable[[Config], Columns]
    finish: Callable[[Config], Columns]
    prepare: Callable[[DataFrame, Config], DataFrame] = nothing
    needs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
