"""Column-level helpers shared by the operators."""
from .num import ratio, rnd, share, to_long
from .geo import haversine_km

__all__ = ["haversine_km", "ratio", "rnd", "share", "to_long"]
