"""Distributed building blocks shared by operators: ordering, ranks, quantiles, pair sums."""
