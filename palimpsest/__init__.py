"""Conversation-log analytics on Spark: pricing, splitting, selecting, pruning, restoring and compacting session histories."""
