"""Categorical sequence analytics as lazy Spark plans."""

from pathwise import sources as io
from pathwise.functions import Alphabet, SequenceConfig, SequencePool, StateSequence, coerce

__all__ = ["Alphabet", "SequenceConfig", "SequencePool", "StateSequence", "coerce", "io"]
