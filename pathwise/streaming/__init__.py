"""Running statistics over a stream of observations."""

from pathwise.streaming.running import observations, running_state_counts, running_transitions

__all__ = ["observations", "running_state_counts", "running_transitions"]
