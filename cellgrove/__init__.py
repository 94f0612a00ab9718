"""Analytics over labelled voxel grids of building interiors, on Spark DataFrames."""
