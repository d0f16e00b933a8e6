"""Readers that turn raw files and tables into typed DataFrames."""
