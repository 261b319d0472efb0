"""Coverage from reads or blocks that arrive over time."""
