"""operators of the track-graph engine."""
