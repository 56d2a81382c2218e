"""Scalar ``Column`` builders."""

from hazecast.functions import aqi, calendar, numeric

__all__ = ["aqi", "calendar", "numeric"]
