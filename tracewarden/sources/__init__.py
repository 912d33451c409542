"""Fact pools, policies, knowledge bases, imports and audit records."""
