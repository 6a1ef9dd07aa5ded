"""Operators for training-data pipelines; each module registers its queries and, where SQL can say it, their SQL."""
