"""Readers and writers: granule listings, manifests, chunk references, cells, documents."""
