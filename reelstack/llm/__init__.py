"""Training-data operators: filtering, scoring, de-duplication, extraction, mixing and formatting.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
