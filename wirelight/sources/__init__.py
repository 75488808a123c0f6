"""Readers that turn raw inputs into typed event tables."""
