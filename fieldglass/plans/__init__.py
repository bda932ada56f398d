"""User-level jobs composed of the operators."""
