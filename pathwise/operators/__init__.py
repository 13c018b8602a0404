"""The operators' public names."""

from pathwise.operators.clustering import (
    CLARAClusteringResult,
    HierarchicalClustering,
    HierarchicalClusteringResult,
    PAMClustering,
    PAMClusteringResult,
    RepresentativeResult,
    clara_clustering,
    clara_pool,
    cluster_quality,
    distance_to_center,
    extract_representatives,
    hierarchical_clustering,
    k_range,
    pam_clustering,
    pam_range,
    silhouette_score,
    silhouette_scores,
)
from pathwise.operators.descriptive import (
    complexity_index,
    describe_sequences,
    longitudinal_entropy,
    mean_time_in_state,
    modal_states,
    normalized_turbulence,
    sequence_frequency_table,
    sequence_length,
    sequence_log_probability,
    spell_count,
    state_distribution,
    subsequence_count,
    transition_count,
    transition_proportion,
    turbulence,
    visited_proportion,
    visited_states,
)
from pathwise.operators.discrepancy import DiscrepancyResult, DissTreeNode, DissTreeResult, discrepancy_analysis, dissimilarity_tree, multi_factor_discrepancy
from pathwise.operators.distances import DistanceMatrix, compute
from pathwise.operators.filters import ContainsStateCriterion, LengthCriterion, QueryCriterion, SequenceCriterion, StartsWithCriterion, TimeCriterion, filter_sequences
from pathwise.operators.mining import association_rules, frequent_subsequences
from pathwise.operators.normative import badness, degradation, individual_state_distribution, insecurity, integration, objective_volatility, precarity, proportion_positive, volatility
from pathwise.operators.transitions import build_substitution_matrix, first_occurrence_time, state_duration_stats, state_spell_stats, substitution_cost_matrix, transition_rate_matrix, transition_rates

__all__ = [name for name in dir() if not name.startswith("_")]
