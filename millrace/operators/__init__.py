"""Data-flow operators: map, reduce, fused reduce-map, partitioners."""
