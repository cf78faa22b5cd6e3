"""Training-data operators: one module each, with their thin ``opN_`` queries in ``queries``."""
