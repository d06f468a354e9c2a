"""DataFrame-to-DataFrame operators: ordering, sessions, models, scores, reports."""
