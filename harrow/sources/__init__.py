"""Tables of URLs and documents from files and texts."""
