"""Sources and sinks: table loading, reference-shaped views, file IO."""
