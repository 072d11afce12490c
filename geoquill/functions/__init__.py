"""Functions on the ellipsoid, for columns and for arrays, from one source."""
