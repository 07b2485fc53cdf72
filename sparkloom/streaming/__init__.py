"""Change events and incremental refresh."""
