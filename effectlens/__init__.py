"""Spark-native evaluation of predicted against measured perturbation experiments."""
