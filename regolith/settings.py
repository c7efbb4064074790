"""Parameters of the terrain jobs. Values are the defaults that results are defined by."""

from __future__ import annotations

from dataclasses import dataclass


# The default weights, limits and sizes.
@dataclass(frozen=True)
class Settings:
    # rasters
    meters_per_pixel: float = 2.0
    elevation_range_m: float = 40.0
    roughness_window: int = 9
    edge_percentile: float = 0.97
    edge_low_ratio: float = 0.5
    min_obstacle_area_px: int = 40
    # hazard
    weight_slope: float = 0.5
    weight_obstacle: float = 0.3
    weight_roughness: float = 0.2
    slope_reference_deg: float = 30.0
    # terrain classes
    crater_min_area_fraction: float = 0.20
    sandy_max_slope_deg: float = 6.0
    sandy_max_roughness: float = 0.12
    sandy_max_area_fraction: float = 0.10
    # planning
    grid_max_dim: int = 192
    energy_slope_coefficient: float = 0.5
    lethal_hazard: float = 0.85
    # risk
    risk_weight_hazard: float = 0.6
    risk_weight_energy: float = 0.4
    tier_low: float = 0.3
    tier_medium: float = 0.6
    margin_fraction: float = 0.85

    def __post_init__(self) -> None:
        total = self.weight_slope + self.weight_obstacle + self.weight_roughness
        if abs(total - 1.0) > 1e-6:
            raise ValueError(f"the three hazard weights must sum to 1.0, not {total:.4f}")
        if self.meters_per_pixel <= 0 or self.slope_reference_deg <= 0:
            raise ValueError("Cell size and slope reference must be positive")


DEFAULT = Settings()
#: For the noise tiles made of embeddings: less relief, so that slopes are those of real ground.
NOISE_TILES = Settings(elevation_range_m=4.0)

# The three reference vehicles.
ROVERS = [
    (0, "Scout-Class (light)", 2.0, 20.0, 0.0018),
    (1, "Survey-Class (medium)", 6.0, 25.0, 0.0030),
    (2, "Heavy Lab-Class", 9.0, 30.0, 0.0062),
]

# The global elevation model's raster.
DEM_COLUMNS, DEM_ROWS, DEM_METERS_PER_PIXEL = 106_694, 53_347, 200.0
NO_DATA = -100_000

# What an upload may be.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
