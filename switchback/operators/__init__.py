"""Operators over DataFrames of roads, slices, samples, places, areas and rides."""
