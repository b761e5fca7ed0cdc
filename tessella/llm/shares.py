"""The percentiles that the queries ask for, as shares."""

SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
