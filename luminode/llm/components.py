"""Connected components, kept among the core operators."""

from luminode.operators.components import connected_components  # noqa: F401
