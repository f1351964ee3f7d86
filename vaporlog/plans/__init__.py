"""End-to-end jobs composed from sources, operators and sinks."""
