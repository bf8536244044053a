"""Large-scale training-data operators.

Nothing outside this subpackage imports it; the entry point adds its
queries only where the subpackage is present.
"""
