"""Operators for large-scale training-data preparation. Nothing else in beamframe imports this subpackage."""
