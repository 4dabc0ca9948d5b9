"""Column expressions and driver-side codecs."""
