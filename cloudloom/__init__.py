"""Point clouds on Spark: ordering, spatial trees, quantised textures, and their sources and sinks."""
