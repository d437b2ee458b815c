"""The batch jobs, composed of operators."""
