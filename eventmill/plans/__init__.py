"""Plan-level helpers: materialisation, graph contraction, salted ranks."""
