"""Metric parameters of the reconstruction and their values in voxels."""

from __future__ import annotations

import math
from dataclasses import dataclass

# fixed values: normal classes
EMPTY, DOWN, UP, HORIZONTAL, UP_AND_DOWN = 0, 1, 2, 3, 4
# fixed values: voxel classes
CEILING, EMPTY_INTERIOR, INTERIOR_OBJECT, FLOOR, WALL, WALL_OPENING = 0, 1, 2, 3, 4, 5
# fixed values: pixel classes
ROOM, PIXEL_WALL, HOLE_INTERIOR, HOLE_BORDER = 0, 1, 2, 3


@dataclass(frozen=True)
class Params:
    """Distances in metres, areas in square metres, angles in degrees."""

    resolution: float = 0.05
    # fixed values: defaults
    down_angle: float = 60.0
    up_angle: float = 45.0
    room_min_area: float = 0.5
    floor_max_step: float = 0.18
    hole_wall_radius: float = 0.2
    hole_border_completeness: float = 0.75
    completion_distance: float = 0.15
    roomlet_min_height: float = 0.5
    roomlet_min_area: float = 0.02
    min_wall_height: float = 0.2
    surface_refinement_distance: float = 0.10
    wall_refinement_radius: float = 0.15
    max_wall_thickness: float = 0.5
    occlusion_distance: float = 0.7
    wall_grid_min_height: float = 1.0
    slope_radius: float = 0.5
    min_ramp_slope: float = 20.0
    max_ramp_slope: float = 50.0
    ramp_min_height: float = 1.2
    ramp_closing_radius: float = 0.25
    first_erosion_radius: float = 0.55
    second_erosion_radius: float = 0.2
    transition_min_width: float = 0.5
    transition_min_height: float = 1.2
    room_min_height: float = 1.0
    contact_min_area: float = 0.5
    contact_min_open_ratio: float = 0.75
    opening_min_height: float = 0.5
    opening_max_jump: float = 0.1
    horizontal_stack_height: float = 0.5
    vertical_segment_min_area: float = 0.1
    normal_min_room_height: float = 1.5

    def voxels(self, metres: float) -> int:
        """A distance in voxels, rounded up."""
        return math.ceil(metres / self.resolution)

    def area(self, square_metres: float) -> int:
        """An area in voxels, rounded up."""
        return math.ceil(square_metres / self.resolution**2)

    @property
    def diagonal(self) -> float:
        """The diagonal of a voxel's square."""
        return math.sqrt(2) * self.resolution
