"""Scalar rules as Column builders."""
