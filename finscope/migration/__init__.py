"""Supplier migration: what to keep, fix, monitor, close or hold, with stewards' decisions over it."""
