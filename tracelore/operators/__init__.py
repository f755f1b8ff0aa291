"""Operators over DataFrames: model upkeep, ranking, index, search, evaluation, trees, lineage."""
