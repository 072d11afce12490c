"""Reading coordinates and grids, writing coordinates."""
