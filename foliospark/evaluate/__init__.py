"""Scores of rendered Markdown against what is expected, and of runs against each other."""
