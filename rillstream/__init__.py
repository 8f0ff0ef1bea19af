"""A PySpark engine that turns packet and event streams into wide session features."""
