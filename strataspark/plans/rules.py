"""The scalars a run is steered by."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Bounds = tuple[float, float, float, float]


@dataclass(frozen=True)
class MapRules:
    """Projects, bounds and corrections of one run.

    ``bounds`` is ``(xmin, ymin, xmax, ymax)`` in ``bounds_epsg`` and takes
    effect only when both are set.  A key of ``exceptions`` without a value maps
    to None, which matches nothing.

    Exceptions and rechecks may also be tables (``key, value`` and ``key``, no key twice), however
    many rows they have: they are joined and never pass through the driver.
    """

    projects: tuple[str, ...] = ()
    bounds: Bounds | None = None
    bounds_epsg: int | None = None
    declination: float = 0.0
    exceptions: Mapping[str, str | None] | DataFrame = field(default_factory=dict)
    rechecks: tuple[str, ...] | DataFrame = ()

    def with_projects(self, projects: tuple[str, ...] | list[str]) -> MapRules:
        """The same rules with more projects (a set union)."""
        merged = tuple(sorted({*self.projects, *projects}))
        return MapRules(
            merged,
            self.bounds,
            self.bounds_epsg,
            self.declination,
            self.exceptions,
            self.rechecks,
        )
