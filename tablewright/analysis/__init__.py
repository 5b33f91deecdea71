"""Column statistics, hypothesis tests, sampling and model evaluation."""
