"""Column functions: calendar, UUIDv7, bounds, names."""
