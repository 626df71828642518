"""Operators for preparing training data: packing, scoring, scans, fingerprints, dedup."""
