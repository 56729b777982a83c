"""Operators on DataFrames: bounds, spatial joins, best matches, nearest neighbours, masks."""

from .bounds import gaussian_bounds
from .drawing import box_wireframe, polylines, surface_points
from .edges import edge_best, edge_pairs, planar_edge_best
from .grids import box_edges, dense_ids, unique_edges, voxel_grid
from .knn import knn_join
from .masks import density_histogram, hit_count, hit_mask, hits, misses, matches, neighbour_split, overlap_boxes
from .voxels import planar_voxel_pairs, voxel_pairs

__all__ = [
    "box_edges", "box_wireframe", "dense_ids", "density_histogram", "edge_best", "edge_pairs", "gaussian_bounds", "hit_count", "hit_mask", "hits", "knn_join", "matches", "misses",
    "neighbour_split", "overlap_boxes", "planar_edge_best", "planar_voxel_pairs", "polylines", "surface_points", "unique_edges", "voxel_grid", "voxel_pairs",
]
