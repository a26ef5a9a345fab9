"""Composite plans: preprocess + score + sinks."""
