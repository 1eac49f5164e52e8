"""Stateful operators, each as a stream and as a batch."""
