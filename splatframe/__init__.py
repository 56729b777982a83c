"""splatframe: geometric analytics over tables of Gaussians, voxels, segments and points, on Spark."""
