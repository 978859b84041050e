"""Training-data pipeline operators. Self-contained: nothing outside this subpackage imports it."""
