"""Settings of a feature run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureConfig:
    """What to compute and how; a wrong value raises ValueError.

    min_chord and surface_sigma are in voxels; voxel_size is a length.
    """

    voxel_size: float = 0.1
    rays: int = 5000
    min_chord: float = 4.0
    phases: tuple[int, ...] = (1, 2, 3)
    use_all_directions: bool = True
    direction: int = 1
    surface_sigma: float = 1.0
    diffusivity: float = 1.0
    boundary_factor: float = 2.0
    rtol: float = 1e-8
    max_iterations: int = 10_000
    recalculate_static: bool = True
    static_phase: int = 2
    verify_static: bool = True
    seed: int = 1

    def __post_init__(self) -> None:
        object.__setattr__(self, "phases", tuple(sorted(self.phases)))
        checks = {
            "voxel_size must be positive": self.voxel_size > 0,
            "rays must be positive": self.rays > 0,
            "min_chord must not be negative": self.min_chord >= 0,
            "phases must not be empty": bool(self.phases),
            "phases must be positive": all(p > 0 for p in self.phases),
            "phases must be unique": len(set(self.phases)) == len(self.phases),
            "direction must be 1, 2 or 3": self.direction in (1, 2, 3),
            "surface_sigma must be positive": self.surface_sigma > 0,
            "diffusivity must be positive": self.diffusivity > 0,
            "boundary_factor must be positive": self.boundary_factor > 0,
            "rtol must be positive": self.rtol > 0,
            "max_iterations must be positive": self.max_iterations > 0,
            "static_phase must be one of phases": self.recalculate_static or self.static_phase in self.phases,
        }
        for message, good in checks.items():
            if not good:
                raise ValueError(message)

    @property
    def directions(self) -> tuple[int, ...]:
        return (1, 2, 3) if self.use_all_directions else (self.direction,)
