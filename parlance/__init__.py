"""Conversation analytics as DataFrame operators."""
