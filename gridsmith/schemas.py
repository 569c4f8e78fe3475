"""Schemas of the engine's relations, and the settings that fix semantics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

PIXELS = "raster_id string, tile_r int, tile_c int, row int, col int, b2 float, b3 float, b4 float, b8 float"
MASK_PIXELS = "source string, year int, row int, col int, m boolean"
RASTER_META = "raster_id string, crs string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, height int, width int, dtype string, nodata double"
MANIFEST = "patch_id string, tile_id string, fold int, row int, col int, bbox string, coffee_ratio double, mask_source string, image_path string, mask_path string"
HISTORY = "model string, source string, fold int, epoch int, lr double, train_loss double, train_iou double, val_loss double, val_iou double"
SCENES = "scene_id long, ts timestamp, cloud_pct double, row int, col int, qa long, b2 double, b3 double, b4 double, b8 double"
FEATURES = "municipio string, variedade string, area double, rings array<array<struct<x:double,y:double>>>"

BANDS = ("b2", "b3", "b4", "b8")


@dataclass(frozen=True)
class Source:
    """A mask source: kind is class (value is the class) , threshold (value is the least probability) or vector."""

    name: str
    kind: str
    value: float | None
    year: int | None
    enabled: bool = True
    native_resolution_m: int = 10


@dataclass(frozen=True)
class Settings:
    region: str = "310044"
    start_date: str = "2018-01-01"
    end_date: str = "2018-12-31"
    cloud_below: float = 20.0
    qa_bits: int = (1 << 10) | (1 << 11)
    patch_size: int = 512
    min_ratio: float = 0.0
    crs: str = "EPSG:31983"
    scale_m: float = 10.0
    folds: int = 5
    seed: int = 42
    loss_weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    sample: int = 10
    bins: int = 32
    chosen: str = "emater"
    sources: tuple[Source, ...] = field(default_factory=lambda: (Source("mapbiomas", "class", 46, 2025), Source("alphaearth", "threshold", 0.28, 2024), Source("emater", "vector", None, 2018)))

    @classmethod
    def load(cls, text: str, required: tuple[str, ...] = ("region", "sources")) -> Settings:
        """Settings from a JSON object; an error that names the required keys it lacks, or keys that are no settings."""
        given = json.loads(text)
        if not isinstance(given, dict):
            raise ValueError("the settings are not an object")
        missing, unknown = sorted(set(required) - set(given)), sorted(set(given) - {f.name for f in fields(cls)})
        if missing or unknown:
            raise ValueError(f"incomplete or unknown settings: missing {missing}, unknown {unknown}")
        given["sources"] = tuple(Source(**s) for s in given.get("sources", ()))
        if "loss_weights" in given:
            given["loss_weights"] = tuple(given["loss_weights"])
        return cls(**given)

    def __post_init__(self) -> None:
        if self.patch_size < 1 or self.folds < 1 or self.scale_m <= 0:
            raise ValueError("patch_size and folds must be at least 1, scale_m above 0")

    def enabled(self) -> list[Source]:
        """In the configured order."""
        return [s for s in self.sources if s.enabled]

    def chosen_source(self) -> Source:
        found = [s for s in self.sources if s.name == self.chosen]
        if not found:
            raise ValueError(f"chosen source {self.chosen!r} is not defined")
        if not found[0].enabled:
            raise ValueError(f"chosen source {self.chosen!r} is not enabled")
        return found[0]

    def years(self) -> list[int]:
        """Distinct years of the enabled sources, the start date's where a source has none."""
        return sorted({s.year if s.year is not None else int(self.start_date[:4]) for s in self.enabled()})
