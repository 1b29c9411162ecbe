"""The Signal: a cell table plus its ordered axis names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "sample_id"


@dataclass(frozen=True)
class Signal:
    """``cells(sample_id, <axis index columns>, re, im | value)``.

    ``samples`` holds one metadata row per sample, ``coords`` one row per
    ``(sample_id, axis, idx)``. Index columns start at 0 and are dense.
    ``sizes`` declares axis lengths that are the same in every sample; an axis
    without one is measured per sample where an operator needs its length.
    """

    cells: DataFrame
    axes: tuple[str, ...]
    samples: DataFrame | None = None
    coords: DataFrame | None = None
    sizes: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = set(self.cells.columns)
        missing = [c for c in (KEY, *self.axes) if c not in names]
        if missing:
            raise ValueError(f"cell table lacks columns {missing}; it has {sorted(names)}")
        if len(set(self.axes)) != len(self.axes):
            raise ValueError(f"axis names must be unique: {self.axes}")
        if not ({"re", "im"} <= names or "value" in names):
            raise ValueError("cell table needs (re, im) or value")

    @property
    def is_complex(self) -> bool:
        return "re" in self.cells.columns

    @property
    def parts(self) -> list[str]:
        return ["re", "im"] if self.is_complex else ["value"]

    @property
    def magnitude(self) -> Column:
        return F.hypot("re", "im") if self.is_complex else F.abs("value")

    def keys(self, *dropped: str) -> list[str]:
        """Sample key and every axis except the dropped ones."""
        return [KEY, *(a for a in self.axes if a not in dropped)]

    def require(self, *axes: str, kind: str | None = None) -> None:
        absent = [a for a in axes if a not in self.axes]
        if absent:
            raise ValueError(f"axes {absent} not found; the signal has {self.axes}")
        if kind == "complex" and not self.is_complex:
            raise ValueError("operator needs complex cells (re, im)")
        if kind == "real" and self.is_complex:
            raise ValueError("operator needs real cells (value)")

    def with_cells(
        self, cells: DataFrame, axes: Iterable[str] | None = None, sizes: Mapping[str, int | None] | None = None
    ) -> Signal:
        """New cells; axes that stay keep their declared size unless ``sizes`` says otherwise."""
        axes = tuple(self.axes if axes is None else axes)
        parts = ["re", "im"] if "re" in cells.columns else ["value"]
        known = {**self.sizes, **(sizes or {})}
        kept = {a: n for a, n in known.items() if a in axes and n is not None}
        return replace(self, cells=cells.select(KEY, *axes, *parts), axes=axes, sizes=kept)

    def with_parts(self, **exprs: Column) -> Signal:
        """Replace the value columns by expressions, keeping the axes."""
        return self.with_cells(
            self.cells.select(*self.keys(), *(e.alias(n) for n, e in exprs.items()))
        )

    def recorded(self, name: str, params: dict, consumed=(), produced=()) -> Signal:
        """Append one provenance record to ``samples.transforms``."""
        if self.samples is None:
            return self
        text = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
        entry = F.struct(
            F.lit(name).alias("name"),
            F.lit(text).alias("params"),
            F.array(*map(F.lit, consumed)).cast("array<string>").alias("consumed"),
            F.array(*map(F.lit, produced)).cast("array<string>").alias("produced"),
        )
        past = (
            F.coalesce(F.col("transforms"), F.array().cast(TRANSFORMS))
            if "transforms" in self.samples.columns
            else F.array().cast(TRANSFORMS)
        )
        return replace(
            self, samples=self.samples.withColumn("transforms", F.concat(past, F.array(entry)))
        )


TRANSFORMS = (
    "array<struct<name:string,params:string,consumed:array<string>,produced:array<string>>>"
)
