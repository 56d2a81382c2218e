"""DataFrame operators keyed by ``series_id``."""
