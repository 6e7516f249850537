"""Part of versespark."""
