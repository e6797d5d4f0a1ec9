"""DataFrame operators: matching, upserts, metrics, scores, reports, tracks."""
