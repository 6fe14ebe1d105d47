"""Column functions: rectangles, segments, rings, cell codes, projections and byte codecs."""
