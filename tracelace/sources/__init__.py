"""sources of the track-graph engine."""
