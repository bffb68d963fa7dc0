"""One-pass and incremental operators."""
