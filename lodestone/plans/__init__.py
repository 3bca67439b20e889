"""Plan-level helpers: runtime services and the registered query catalogue."""
