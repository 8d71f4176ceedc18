"""Distributed building blocks and operators."""
