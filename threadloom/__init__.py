"""Conversation-corpus analytics on Spark DataFrames."""
