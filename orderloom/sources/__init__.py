"""Table sources, sinks and column bindings."""
