"""Structured Streaming forms of layer ranking (Q1) and chat session state (Q2)."""
