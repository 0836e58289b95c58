"""Inputs: shape files, schema snapshots and property graphs over DataFrames."""
