"""Operators for preparing text: duplicates, archives, mixing, language, quality, shards, fingerprints, packing.

They work on the text fields of the registry (``edges``, ``edge_versions``, ``ai_outputs``) and on the payloads
of ``events``. Nothing else in the library imports this subpackage.
"""
