"""Column-level building blocks: hashing, vectors, parsing, raster formulas."""
