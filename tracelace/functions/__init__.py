"""functions of the track-graph engine."""
