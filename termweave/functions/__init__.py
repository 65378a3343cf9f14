"""Column functions: normalising, tokenising, folding, stemming, scoring."""
