"""Application-layer decoding."""
