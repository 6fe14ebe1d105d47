"""Sources and sinks for feature tables."""
