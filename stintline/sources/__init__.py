"""Feed readers, sinks and the fixture views."""
