"""Training-data operators over document, benchmark, label and conversation tables."""
