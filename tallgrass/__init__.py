"""Dependency audits of many JavaScript and TypeScript projects at once, on Spark."""
