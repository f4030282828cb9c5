"""All thresholds of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    """Cells of a slice along x, y and z, and the edge of a cell in feet."""

    x: int = 400
    y: int = 400
    z: int = 200
    voxel_ft: float = 0.5


@dataclass(frozen=True)
class Detection:
    """From scores to accepted components of a slice (fixed values)."""

    semantic_weight: float = 0.55
    binary_weight: float = 0.35
    object_weight: float = 0.10
    pole_candidate: float = 0.15
    pole_competition: float = 0.8
    line_weak: float = 0.04
    line_strong: float = 0.08
    line_competition: float = 0.55
    pole_min_voxels: int = 4
    line_min_voxels: int = 3
    core: int = 48
    edge_width: int = 10
    exact_distance: float = 1e-9
    near_distance: float = 2.5


@dataclass(frozen=True)
class Reconstruction:
    """From the objects of a window of slices to poles, chains and spans (fixed values; feet and degrees)."""

    world_units_to_ft: float = 0.5
    pole_merge_radius: float = 4.0
    min_pole_separation: float = 10.0
    max_span_length: float = 450.0
    max_span_slices: int = 9
    slice_length: float = 50.0
    join_radius: float = 14.0
    missing_slice_extra: float = 8.0
    join_angle: float = 18.0
    connector_angle: float = 25.0
    join_lateral: float = 1.5
    join_vertical: float = 14.0
    vertical_ratio: float = 0.35
    z_extrapolation: float = 2.5
    longitudinal_overlap: float = 3.0
    overlap_xy_radius: float = 2.0
    overlap_vertical: float = 2.0
    bridge_radius: float = 30.0
    bridge_angle: float = 10.0
    bridge_connector_angle: float = 15.0
    bridge_lateral: float = 1.0
    bridge_z_extrapolation: float = 2.0
    self_intersection_tolerance: float = 0.25
    attachment_radius: float = 28.0
    attachment_close: float = 4.0
    attachment_angle: float = 40.0
    attachment_height_delta: float = 18.0
    top_margin: float = 1.5
    height_variation: float = 8.0
    max_height_adjust: float = 8.0
    min_pole_height: float = 15.0
    fixed_pole_height: float | None = None
    height_quantile_low: float = 0.1
    height_quantile_high: float = 0.9
    height_range_margin: float = 2.0
    attachment_height_slack: float = 1.5
    span_angle: float = 12.0
    span_connector_angle: float = 15.0
    span_lateral: float = 1.5
    span_z_error: float = 3.0
    span_gap: float = 100.0
    span_corridor: float = 10.0
    span_pole_extrapolation: float = 35.0
    span_min_tracks: int = 2
    span_min_coverage: float = 0.15
    hidden_line_angle: float = 20.0
    hidden_endpoint_extrapolation: float = 20.0
    hidden_backtrack: float = 1.0
    hidden_z_spread: float = 15.0
    hidden_support_radius: float = 35.0
    hidden_exclusion: float = 6.0
    hidden_cluster_radius: float = 4.0
    hidden_ground_radius: float = 150.0
    hidden_min_evidence: float = 2.0
    smooth_spacing: float = 2.0
    min_chain_horizontal: float = 3.0
    max_vertical_horizontal: float = 1.0

    def __post_init__(self):
        if self.max_span_slices * self.slice_length != self.max_span_length:
            raise ValueError("max_span_slices * slice_length must be max_span_length")
