"""Readers, file inventories and sinks."""
