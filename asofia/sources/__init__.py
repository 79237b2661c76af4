"""Tables and files that operators start from or end in."""
