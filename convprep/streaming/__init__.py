"""The row-wise part of the batch plans over arriving files."""
