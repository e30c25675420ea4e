"""Readers: files of projects, and their manifests."""
