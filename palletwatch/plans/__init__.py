"""The registered queries: operators applied to the delivery tables."""
