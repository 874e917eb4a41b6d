"""DataFrame -> DataFrame operators, each covering every session in one call."""
