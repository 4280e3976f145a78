"""Helpers that decide how a plan is cut, stored and joined."""
