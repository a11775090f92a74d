"""plinth: DataFrame operators for resolved, explainable record archives."""
