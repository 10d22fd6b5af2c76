"""DataFrame-in, DataFrame-out operators of the phrase-mining and extraction engine."""
