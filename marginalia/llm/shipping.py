"""The package for Python workers that cannot import it by themselves."""

from marginalia.shipping import ship

__all__ = ["ship"]
