"""Part of the fragmill engine."""
