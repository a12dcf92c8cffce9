"""Column functions: planar geometry, map projections, tiles, geohash and WKB."""
