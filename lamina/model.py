"""Options of the segmentation, and the named presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SegmentOptions:
    bg_threshold: int = 35
    surface_threshold: int | None = 18
    min_area_px: int = 80
    min_bbox_px: int = 5
    max_layers: int = 500
    dilation_px: int = 3
    crop_padding_px: int = 3
    alpha_low: int = 12
    alpha_high: int = 70
    partition: bool = False
    internal_details: bool = False


#: The presets, each plain and compact.
PRESETS = {
    ("heavy", False): SegmentOptions(24, None, 5, 1, 10000, 0, 1, 4, 55, True, True),
    ("heavy", True): SegmentOptions(24, None, 18, 1, 2500, 0, 1, 4, 55, True, True),
    ("granular", False): SegmentOptions(18, None, 12, 2, 3000, 0, 1, 4, 48),
    ("granular", True): SegmentOptions(18, None, 60, 2, 700, 0, 1, 4, 48),
    ("grouped", False): SegmentOptions(42, 18, 120, 5, 500, 3, 3, 12, 70),
    ("grouped", True): SegmentOptions(42, 18, 180, 5, 260, 3, 3, 12, 70),
    ("balanced", False): SegmentOptions(35, 18, 80, 5, 500, 3, 3, 12, 70),
    ("balanced", True): SegmentOptions(35, 18, 140, 5, 320, 3, 3, 12, 70),
}


def preset(mode: str, compact: bool = False) -> SegmentOptions:
    """Options by name; a name that isn't known means balanced."""
    return PRESETS.get((mode, compact), PRESETS["balanced", compact])


def presets(spark: SparkSession) -> DataFrame:
    """The presets as a table of eight rows."""
    kinds = "mode string, compact boolean, bg_threshold int, surface_threshold int, min_area_px int, min_bbox_px int, max_layers int, dilation_px int, crop_padding_px int, alpha_low int, alpha_high int, partition boolean, internal_details boolean"
    return spark.createDataFrame([(m, c, *asdict(o).values()) for (m, c), o in PRESETS.items()], kinds)
