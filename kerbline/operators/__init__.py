"""Row, join, window and aggregate operators: ``DataFrame -> DataFrame``."""
