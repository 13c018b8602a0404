"""The data model: column mapping, alphabet, pool."""

from pathwise.functions.model import Alphabet, SequenceConfig, SequencePool, StateSequence, coerce

__all__ = ["Alphabet", "SequenceConfig", "SequencePool", "StateSequence", "coerce"]
