"""Readers and writers: file listings, binary tensors, images, logs, tables."""
