from perigee.functions.columns import (
    band_labels,
    closest_key,
    hazard_label,
    in_year,
    month_start,
    month_text,
    velocity_band,
)

__all__ = [
    "band_labels",
    "closest_key",
    "hazard_label",
    "in_year",
    "month_start",
    "month_text",
    "velocity_band",
]
