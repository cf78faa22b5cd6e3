"""See the README for what lives in ``waymark.functions``."""
