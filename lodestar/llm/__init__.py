"""Training-data operators: one module each, plus the registry in ``queries``."""
