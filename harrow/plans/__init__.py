"""Whole dataflows put together from sources and operators."""
