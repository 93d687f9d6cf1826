"""Queries over the driver's tables."""


def load():
    """Import every query module and return the registry."""
    from . import q_eval, q_features, q_market, q_models, q_scalars, q_sources, q_streaming, registry  # noqa: F401
    return registry
