"""From rules to DataFrames: value sets, paths, conditions, violations, fused scans."""
