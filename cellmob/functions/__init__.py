from cellmob.functions.geo import haversine, in_area
from cellmob.functions.scalar import day_key, hour_frame, weighted_crowd, whole_km

__all__ = ["day_key", "haversine", "hour_frame", "in_area", "weighted_crowd", "whole_km"]
