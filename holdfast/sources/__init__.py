"""Readers, sinks and the account view over the driver tables."""
