"""Operators over columns of JSON documents."""
