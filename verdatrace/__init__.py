"""Raster time-series analytics on Spark DataFrames.

Pixels are rows, not arrays: observations are long tables keyed by scene, date,
row and column, and every operator is a function from DataFrames to a
DataFrame that Catalyst is free to arrange.
"""
