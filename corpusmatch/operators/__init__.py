"""Operators: frames and parameters in, frames out; no action inside."""
