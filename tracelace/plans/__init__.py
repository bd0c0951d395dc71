"""plans of the track-graph engine."""
