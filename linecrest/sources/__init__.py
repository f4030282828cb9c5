"""Readers and writers: trees of slice files, audited objects, artifacts of stages, manifests."""
