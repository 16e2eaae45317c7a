"""End-to-end flows: prepare training data, evaluate runs, converse."""
