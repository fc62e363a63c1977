"""Small expressions that the operators share."""

from .expressions import percent, quoted, rate, whole

__all__ = ["percent", "quoted", "rate", "whole"]
