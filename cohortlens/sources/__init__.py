"""Readers, writers and the proxy views over the driver's test tables."""
