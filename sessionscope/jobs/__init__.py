"""Batch entry points: build, detect, evaluate, analyse."""
