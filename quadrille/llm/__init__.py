"""Training-data operators: mixing, search, classifiers, dedup, scans and tokenisers.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
