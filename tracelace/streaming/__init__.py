"""streaming of the track-graph engine."""
