"""Row operators: feature split, normalisers, class labels and key (P1, P2), scoring (M1, M2) as
columns, batches, joins or sequences, row index (P5), report."""

from veloscore.operators.attaching import attach, score_attached
from veloscore.operators.features import split_features, tag_key
from veloscore.operators.indexing import row_index
from veloscore.operators.labels import decode_labels, encode_labels, label_dictionary
from veloscore.operators.normalise import feature_statistics, fit_normaliser
from veloscore.operators.relational import score_relational, score_table
from veloscore.operators.reporting import report
from veloscore.operators.scoring import score, score_batched, score_native
from veloscore.operators.sequence import score_sequence

__all__ = ["attach", "decode_labels", "encode_labels", "feature_statistics", "fit_normaliser", "label_dictionary",
           "report", "row_index", "score", "score_attached", "score_batched", "score_native", "score_relational",
           "score_sequence", "score_table", "split_features", "tag_key"]
