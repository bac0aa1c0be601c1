"""Reading and writing posts, dimensions, label maps and result tables."""
