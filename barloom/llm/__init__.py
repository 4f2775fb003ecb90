"""Operators for preparing training corpora at scale. Nothing else in barloom imports this subpackage."""
