"""Readers and writers of meshes, point clouds and grids."""
