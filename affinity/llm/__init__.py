"""Training-data operators: one module per operator, sharing ``text`` (byte
kernels), ``exchange`` (packed key exchange) and ``components``.

Nothing outside this subpackage imports it; ``catalog`` registers its queries.
"""
