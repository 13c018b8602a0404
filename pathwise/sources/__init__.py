"""Readers, writers and generators of sequence tables."""

from pathwise.sources.intervals import sample_intervals
from pathwise.sources.loaders import load_csv, load_dataframe, load_json, load_parquet, save_csv, save_json, save_parquet
from pathwise.sources.synthetic import generate_financial_journeys, generate_markov_sequences, generate_simple_sequences

__all__ = [
    "generate_financial_journeys",
    "generate_markov_sequences",
    "generate_simple_sequences",
    "load_csv",
    "load_dataframe",
    "load_json",
    "load_parquet",
    "sample_intervals",
    "save_csv",
    "save_json",
    "save_parquet",
]
