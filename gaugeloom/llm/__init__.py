"""Operators of a training-data pipeline: de-duplication, fingerprints, filters, mixing, packing."""
