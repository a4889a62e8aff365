"""Part of Tarnwell."""
