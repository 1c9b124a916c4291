"""Spark operators for fleets of multi-period grid-dispatch linear programs."""
